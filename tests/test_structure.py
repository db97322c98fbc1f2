"""Regions of nested pages, numeric references, and odd pages."""

from pyspark.sql import functions as F

from quarry.sources import structure

BASE = "https://h.example/a/b"


def test_regions_nest(spark):
    html = "<div id='1'>a<div id='2'>b<select>c</div>d</select></div><div id='3'>e<DIV/>f"
    scan = structure.tags(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html")
    found = {structure_id: (begin, end, text) for structure_id, begin, end, text in structure.contents(scan, structure.regions(scan, "k", "div"), "k").select(structure.attribute("tag", "id"), "begin", "end", "text").collect()}
    assert found["1"] == (0, 5, "a b c d") and found["2"] == (1, 3, "b c") and found["3"] == (6, None, "e f")
    held = structure.holders(scan.where("name = 'select' and opens").select("k", "n"), structure.regions(scan, "k", "div"), "k").collect()
    assert [(r.n, r.holder) for r in held] == [(2, 1)]


def test_references_and_addresses(spark):
    row = spark.createDataFrame([("a&#233;&#xE9;&#128512;&#0;&#x110000;&#12", "?q=1", "../x")], "a string, q string, r string").select(
        structure.numeric_references("a").alias("a"), structure.absolute(F.lit("//o.example/x"), BASE).alias("b"), structure.absolute(F.lit("/x"), BASE).alias("c"), structure.absolute(F.lit("x?a=1&amp;b=2"), BASE).alias("d"), structure.absolute(F.lit("http://z/"), BASE).alias("e")
    ).first()
    assert tuple(row) == ("aéé😀&#0;&#x110000;&#12", "https://o.example/x", "https://h.example/x", "https://h.example/a/x?a=1&b=2", "http://z/")


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no tags"), (4, "<h3>Federais</h3><select><option value='/x/downloadDividaFederal/1'>A</option></select>"), (5, "<div class='comunicado'><div><p>a</p></div></div>b</div>")], "k long, html string")
    assert structure.panel_links(pages, "k", "html", BASE).collect() == []  # no panel names a year
    assert structure.communication_links(pages, "k", "html", BASE).collect() == []
    got = {r.k: (r.title, r.summary, r.text, r.documents) for r in structure.communications(pages, "k", "html", BASE).collect()}
    assert got == {1: (None, None, None, []), 2: (None, None, None, []), 3: (None, None, "no tags", []), 4: (None, None, "FederaisA", []), 5: (None, "a", "a", [])}


def test_a_heading_counts_once_and_panels_follow_selects(spark):
    select = "<select><option value='/x/downloadDividaEstOrdem/{0}'>E{0}</option></select>"
    panel = "<div class='panel-heading'>{}</div>"
    html = "<h3>Estaduais e Municipais</h3><h4>Ordem Cronologica</h4>" + panel.format(2020) + panel.format(2021) + select.format(1) + select.format(2) + "<h4>Outra</h4><h4>Ordem Cronológica</h4>" + panel.format(2022) + select.format(3)
    got = structure.panel_links(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html", BASE).collect()
    assert [(r.year, r.path_id, r.debtor_name) for r in got] == [(2020, "1", "E1")]


def test_long_pages(spark):
    """What a page's 20,000 regions hold is joined by its place, not each region with each tag (800 million pairs); a region that nothing closes reaches to the end, and one behind all rows holds none."""
    scan = structure.tags(spark.createDataFrame([(1, "<p>x</p>" * 20_000 + "<p>y<b>z"), (2, "<b>q</b><p>r")], "k long, html string"), "k", "html")
    regions = structure.regions(scan, "k", "p")
    assert sorted(map(tuple, structure.contents(scan, regions, "k").groupBy("k", "text").count().collect())) == [(1, "x", 20_000), (1, "y z", 1), (2, "r", 1)]
    held = structure.holders(scan.where("name = 'b' and opens").select("k", "n"), regions, "k").collect()
    assert [(r.k, r.n, r.holder) for r in held] == [(1, 40_001, 40_000)]
    joins = [line for line in structure.contents(scan, regions, "k")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert joins and not any("<" in line and "(n#" in line and "begin#" in line for line in joins)
