"""Mixing and boilerplate lines: against their SQL on small tables, marginals,
defined cases, and no Python in the plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

from residuum.llm import mixing
from residuum.llm.line_dedup import drop_boilerplate
from residuum.llm.mixing import mix, sample
from residuum.llm.queries import QUERIES, SQL

from .conftest import clashing, documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_mixing", "op5_line_dedup"])
def test_equals_sql(spark, work, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    key = names.index("doc_id" if name == "op4_mixing" else "page_id")
    rows = sorted(want.fetchall(), key=lambda r: r[key])
    df = QUERIES[name](spark, SF).select(*names)
    assert [tuple(r) for r in sorted(df.collect(), key=lambda r: r[key])] == rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def docs_of(spark):
    rows = [(i, "w " * (5 + i % 7) + ("why?" if i % 3 else "x@y"), ("en", "de", None)[i % 3 if i % 5 else 0], ("big" if i % 4 else "small") if i % 11 else None, 1) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_marginals_are_met(spark, work):
    targets = {"source": spark.createDataFrame([("big", 0.5), ("small", 0.4), ("(none)", 0.1)], "value string, share double"),
               "lang": spark.createDataFrame([("en", 0.5), ("de", 0.3), ("(none)", 0.2)], "value string, share double")}
    out = mix(docs_of(spark), work, targets, iterations=60)
    total = out.agg(F.sum(F.col("n_tokens") * F.col("weight"))).first()[0]
    for column, want in (("source", {"big": 0.5, "small": 0.4, "(none)": 0.1}), ("lang", {"en": 0.5, "de": 0.3, "(none)": 0.2})):
        got = {r[0]: r[1] / total for r in out.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    assert out.agg(F.max("probability")).first()[0] == 1.0


def test_sample_is_repeatable_and_keeps_rows(spark, work):
    docs = clashing(docs_of(spark))
    a, b = sample(docs, work), sample(docs.repartition(7), work)
    assert a.columns == docs.columns
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
    assert sorted(r.doc_id for r in mix(docs, work).filter("selected").collect()) == sorted(r.doc_id for r in a.collect())


def test_one_task_or_many_rake_alike(spark, work, monkeypatch):
    one = {r.doc_id: r.weight for r in mix(docs_of(spark), work).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    many = {r.doc_id: r.weight for r in mix(docs_of(spark), work).collect()}
    assert one == pytest.approx(many, rel=1e-12)


def test_rare_documents_do_not_set_the_rate(spark, work):
    common = spark.range(900).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 3000).alias("text"), F.when(F.col("id") % 3 > 0, "en").otherwise("de").alias("lang"),
        F.when(F.col("id") % 5 > 0, "big").otherwise("small").alias("source"), F.lit(6000).cast("long").alias("n_chars"))
    rare = spark.createDataFrame([(1000, "a b c d e f g h i j", "en", None, 19), (1001, "a", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda rows: sum(r.n_tokens * r.probability for r in rows) / sum(r.n_tokens for r in rows)
    alone, both = mix(common, work).collect(), mix(common.union(rare), work).collect()
    assert kept(both) == pytest.approx(kept(alone), abs=0.01) and kept(both) > 0.7
    assert [r.probability for r in both if r.doc_id >= 1000] == [1.0, 1.0]
    assert {r.doc_id for r in sample(common.union(rare), work).collect()} == {r.doc_id for r in both if r.selected} >= {1000, 1001}
    # a rare value that a target asks for does set the rate: its target is met
    out = mix(common.union(rare), work, {"source": spark.createDataFrame([("big", 0.5), ("small", 0.4), ("(none)", 0.1)], "value string, share double")}).collect()
    assert sum(r.n_tokens * r.probability for r in out if r.source == "(none)") / sum(r.n_tokens * r.probability for r in out) == pytest.approx(0.1, abs=0.01)


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_rare_cells_equal_sql(spark, work, monkeypatch, one_task):
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", one_task)
    rows = [(i, "w " * (500 + i % 7) + ("why?" if i % 3 else "x@y"), "en" if i % 2 else "de", "big" if i % 5 else "small", 1) for i in range(400)]
    rows += [(1000, "a b c", "en", None, 1), (1001, "a", None, None, 1), (1002, "", "xx", "yy", 1), (1003, "b c://d", "de", "rare", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in mix(docs, work).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(SQL["op4_mixing"])
    names = [d[0] for d in want.description]
    for row in want.fetchall():
        w, r = dict(zip(names, row)), got[row[names.index("doc_id")]]
        assert (r.source, r.lang, r.topic, r.n_tokens, r.selected) == tuple(w[c] for c in ("source", "lang", "topic", "n_tokens", "selected"))
        assert (r.weight, r.probability) == pytest.approx((w["weight"], w["probability"]), rel=1e-6)
    assert sum(r.probability == 1.0 for r in got.values()) > 3 and len(got) == len(rows)


def test_cases_of_mixing(spark, work):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (4, "w " * 100_000, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = mix(docs, work).collect()
    assert len(out) == 5 and all(0 <= r.probability <= 1 for r in out)
    assert {r.n_tokens for r in out} == {0, 2, 100_000}
    assert mix(docs.filter("doc_id = 9"), work).count() == 0
    assert mix(docs.filter("doc_id = 1"), work).first().weight == 1.0
    assert documents(spark, [(1, "x")]).count() == 1


PAGES = "page_id long, url string, html string"


def test_lines_of_a_site(spark, work):
    rows = [(i, f"https://User@Site.example:80/{i}", f"<p>Menu</p><div>own {i}<br>Menu\n <b>bold</b> tail") for i in range(10)]
    rows += [(20 + i, "http://few.example/", "<p>same") for i in range(3)] + [(30, None, None), (31, "nonsense", ""), (32, "x", "<p>a<p>b"), (0, rows[0][1], rows[0][2])]
    rows += [(40, "http://long/", "<p>line" * 50_000)]
    out = {}
    for r in drop_boilerplate(clashing(spark.createDataFrame(rows, PAGES)), work).collect():
        out.setdefault(r.page_id, []).append(r)
    assert len(out[0]) == 2 and out[5][0].host == "site.example"
    assert out[5][0].text == "own 5" and (out[5][0].n_lines, out[5][0].n_dropped) == (4, 3)
    assert out[0][0].text == "own 0"                       # 2 of 11 pages: below the ratio
    assert out[20][0].text == "" and out[20][0].n_dropped == 1  # 3 of 3 pages, however small the host
    assert out[30][0].text == "" and out[32][0].text == "a\nb"
    assert out[40][0].n_lines == 50_000 and out[40][0].n_dropped == 0
    assert drop_boilerplate(spark.createDataFrame([], PAGES), work).count() == 0
