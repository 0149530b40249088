"""Pages against their SQL: cut entities and others that the SQL leaves alone, blanks of all kinds."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barline.plans import catalogue
from tests import oracle

CUT = ["<title>a&&&amp</title><p>b &amp; c", "&am", "&quot x", "&copy 1&copy; 2", "&#39", "&AMP; &mdash; &#8217; &#x27;", "&amp;lt; &amp;amp;", "&am&amp;p;", "<p>&lt;b&gt;</p>&nbsp;&middot;&apos;&#39;&quot;"]
BLANK = [f"{chr(c)}a{chr(c)}{chr(c)} b{chr(c)}" for c in [*range(0x100), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
OTHER = [None, "", "  ", "<>", "a <b", "<a\nb>x", "x" * 299 + " \n y", "\U0001f600" * 301, "<i>" * 200]


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    html = CUT + BLANK + OTHER
    table = pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array(["u"] * len(html)), "html": pa.array(html, pa.string())})
    pq.write_table(table, f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{folder}/pages.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["clean_html", "html_unescape"])
def test_odd_pages_equal_sql(spark, pages, name):
    folder, con = pages
    oracle.same(spark, con, folder, catalogue.QUERIES[name], catalogue.SQL[name])
