from marginalia.operators import scout

FOUND = [
    (0, "citing", "Dams after the flood of record", "2014", None, "Ngata P."),
    (1, "search", "Radar gauges in steep streams", "2016", "10.4321/gauge", ""),
    (2, "search", "Bed load of braided rivers", "2009", "10.4321/bedload", ""),
    (3, "search", "Snow courses, a century of them", "2010", "10.4321/SNOW", ""),
    (4, "search", "Weirs and their keepers", "2009", None, "Okafor B, Pires C."),
    (5, "search", "what floods leave behind", "2012", "10.4321/own", ""),
    (6, "search", "Dams after the flood of record.", "2014", "10.4321/dams", ""),
    (7, "search", "Levees of one wet year", "2012", "10.4321/levee", ""),
    (8, "search", "Reservoirs and silt", "2013", "10.4321/dams", ""),
    (9, "search", "Without a date", None, "10.4321/nodate", ""),
    (10, "search", "Behind the one without a date", "2013", "10.4321/nodate", ""),
    (11, "search", "...", "2013", "", ""),
]


def tables(spark):
    found = spark.createDataFrame([("p", o, v, t, y, d, "", "", a) for o, v, t, y, d, a in FOUND], "paper string, ord int, via string, title string, pub_year string, doi string, journal string, abbreviation string, authors string")
    papers = spark.createDataFrame([("p", "Spring floods of narrow valleys", "10.4321/own", 2012)], "paper string, paper_title string, paper_doi string, paper_year int")
    refs = spark.createDataFrame([("p", "10.4321/SNOW", "quist-2010"), ("p", None, "okafor-2009")], "paper string, doi string, slug string")
    return scout.hits(found), papers, refs


def test_registers(spark):
    newer, overlooked = scout.registers(*tables(spark))
    assert [(r.year, r.title) for r in newer.orderBy("rank").collect()] == [(2016, "Radar gauges in steep streams"), (2014, "Dams after the flood of record"), (2013, "Reservoirs and silt")]
    assert [r.title for r in overlooked.orderBy("rank").collect()] == ["Levees of one wet year", "Bed load of braided rivers"]


def test_soft_failure_keeps_order_and_all(spark):
    rows = scout.split_by_year(scout.ordered_dedup(*tables(spark)[:2])).where("newer")
    bad = scout.soft_failed(rows, spark.createDataFrame([("p",)], "paper string"), 2)
    assert [r.ord for r in bad.orderBy("rank").collect()] == [0, 1, 8]
    assert scout.soft_failed(rows, spark.createDataFrame([("x",)], "paper string"), 2).count() == 2
