"""References cut before their semicolon: the queries read them as their SQL does, the operators by HTML's rules."""

import duckdb
import pytest

from harrow.functions import dom, udfs
from harrow.oracles import ORACLES
from harrow.queries import QUERIES

#: Each with a page_id at which the predicted title is the page's.
TITLES = {6: "ß&amp;&amp", 12: "token = &quot", 18: "&copy2 &ltd &amp;lt; &lt;b&gt;", 24: "&am", 30: "a &nbsp; b &middot;", 36: "&", 42: "plain"}


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """A folder of pages, and DuckDB over it."""
    at = str(tmp_path_factory.mktemp("cut"))
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    for i, t in TITLES.items():
        page = f'<!DOCTYPE html><html lang="de"><head><title>{t}</title><script>"&amp"</script></head><body><h1>{t}</h1><p><b>{t} <a href="/&amp">x</a></p><footer>&copy</footer></body></html>'
        duck.execute("insert into pages values (?, ?, ?)", [i, f"http://s{i % 4}.example.org/{i}", page])
    duck.execute(f"copy pages to '{at}/pages.parquet' (format parquet)")
    return at, duck


def check(spark, cut, name):
    at, duck = cut
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, at).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_clean_text_dom_equals_its_sql(spark, cut):
    check(spark, cut, "clean_text_dom")


@pytest.mark.parametrize("name", ["page_counts", "page_site_field", "page_by_site", "page_by_field", "page_overall"])
def test_page_counts_and_averages_equal_their_sql(spark, cut, name):
    check(spark, cut, name)


def test_page_samples_equal_their_sql(spark, cut):
    check(spark, cut, "page_samples")


def test_clean_html_reads_by_html_rules_unless_told():
    page = "<p>a&amp;&amp</p><p> &eacute; b&copy</p>"
    assert dom.clean_html(page, keep_tags=False) == "a&&  é b©"
    assert dom.clean_html(page, keep_tags=False, unescape=lambda t: t.replace("&amp;", "+")) == "a+&amp  &eacute; b&copy"
    assert dom.clean_html("&lt;i>a&amp;amp</i>", keep_tags=False, rag=True, unescape=lambda t: t.replace("&lt;", "<").replace("&amp;", "&")) == "a&amp"


def test_gold_texts_read_by_html_rules_unless_told():
    gold, pred = '{"t": "a&amp"}', '{"t": "a amp"}'
    assert [m["hit"] for m in (*udfs.field_marks(gold, pred), *udfs.field_marks(gold, pred, unescape=str), *udfs.field_marks(gold, pred, 100, unescape=str))] == [False, True, True]
