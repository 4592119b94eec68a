"""The registered queries on the given tables, and the pipeline stage by stage."""

import html
import re

import __spark_entry__ as entry_points
import corpus_pipeline
import pytest
from compare import as_pandas, differences, duck

from lectern.llm import ngram_join, stages
from lectern.llm.common import table
from lectern.llm.html_blocks import main_text
from lectern.llm.oracles import llm_oracles
from lectern.llm.queries import llm_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_agrees_with_sql(spark, con, name):
    got = as_pandas(llm_queries()[name](spark, SF))
    assert differences(got, con.execute(llm_oracles()[name]).df()) is None


def test_main_text_of_every_page(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = llm_queries()["op6_main_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {k: main_text(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) and "©" not in r.text for r in got)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text_by_the_blocks_of_the_article(spark, tag):
    """With and without the mark of the article, against a reader of these pages alone."""
    for r in table(spark, SF, "pages").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = re.split("</?(?:h1|p|ul|li|div)>", re.sub("<br>", " ", inner))
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        page = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
        assert main_text(page) == "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("name", ["op5_shards", "op7_quality", "op8_toxicity"])
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    assert sorted(r.doc_id for r in llm_queries()[name](spark, SF).collect()) == ids


def test_pipeline_is_its_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in stages.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF)
        docs = corpus_pipeline.stored(docs, name)
        assert docs.columns == columns
        assert docs.join(before, columns, "left_anti").count() == 0
        if name == "near_duplicates":
            groups = ngram_join.near_duplicates(docs).collect()
            assert all(g.doc_id == g.component_id for g in groups)
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    result = entry_points.queries()["pipeline"](spark, SF).collect()
    assert sorted(r.doc_id for r in result) == ids
