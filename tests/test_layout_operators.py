from pyspark.sql import functions as F

from ledgerloom.operators.detection import available_banks, choose_parse, detect_layout
from ledgerloom.operators.grid import cluster_rows, column_of, grid_cells, grid_markdown, join_runs

ITEMS = "page long, x double, y double, width double, height double, font_size double, seq long, text string"


def test_rows_follow_their_first_item_not_the_last(spark):
    ys = [10.0, 13.0, 14.5, 17.0, 30.0, 30.0]  # the tolerance is 4: 14.5 is near 13 but too far from 10
    df = spark.createDataFrame([(1, 0.0, y, 5.0, 10.0, 8.0, i, "t") for i, y in enumerate(ys)] + [(2, 0.0, 5.0, 5.0, None, 8.0, 0, "t")], ITEMS)
    got = {(r.page, r.seq): r.row_no for r in cluster_rows(df, ["page"]).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 2, (2, 0): 0}
    assert cluster_rows(df.where("false"), ["page"]).count() == 0


def test_columns_and_cells(spark):
    edges = F.array(*map(F.lit, (40.0, 120.0)))
    row = spark.range(1).select(*[column_of(F.lit(x), edges).alias(n) for x, n in ((0.0, "a"), (117.5, "b"), (117.4, "c"))]).head()
    assert tuple(row) == (0, 1, 0)
    df = spark.createDataFrame([(1, 40.0, 5.0, 10.0, 8.0, 8.0, 0, "AB"), (1, 50.0, 5.0, 10.0, 8.0, 8.0, 1, "CD"), (1, 70.0, 5.0, 10.0, 8.0, 8.0, 2, " E  F ")], ITEMS)
    assert grid_cells(df, ["page"], edges, 2).head().cells == ["ABCD E F", ""]
    assert spark.range(1).select(join_runs(F.expr("cast(array() as array<struct<x:double,seq:bigint,width:double,font_size:double,text:string>>)")).alias("t")).head().t == ""


def test_markdown_over_pages(spark):
    rows = spark.createDataFrame([("s", p, r, [f"{p}-{r}", "x"]) for p in range(3) for r in range(40)] + [("t", 1, 0, ["a|b", None])], "id string, page long, row_no long, cells array<string>")
    got = {r.id: r.markdown.split("\n")[2:] for r in grid_markdown(rows, "id", 2, order=("page", "row_no")).collect()}
    assert got == {"s": [f"| {i // 40}-{i % 40} | x |" for i in range(60)], "t": ["| a\\|b |  |"]}


def test_layouts(spark):
    rows = [(1, "HDFC  Bank IFSC HDFC0123456", None), (2, "éUTIB0000789 axis bank", None), (3, None, None), (4, "nothing", "pnb-savings-v1"), (5, "hdfc bank", None), (6, "hdfc bank HDFC0123456", "no-such"), (7, "hdfc bank hdfc0123456", None)]
    got = {r.id: (r.layout_id, r.confidence) for r in detect_layout(spark.createDataFrame(rows, "id long, t string, h string"), "t", "h").collect()}
    assert got == {1: ("hdfc-savings-v1", 1.0), 2: ("axis-savings-v1", 1.0), 3: (None, None), 4: ("pnb-savings-v1", 0.7), 5: (None, None), 6: ("hdfc-savings-v1", 1.0), 7: (None, None)}


def test_banks_and_choice(spark):
    none = spark.createDataFrame([], "key long, bank string, learned_at long")
    assert available_banks(none).count() == 12
    tried = [(1, 1, False, True), (1, 2, True, True), (2, 2, False, False), (3, 2, False, True), (3, 3, False, True), (4, 1, False, False), (5, 3, True, True), (6, 2, None, True), (6, 4, None, True)]
    got = {r.statement_id: tuple(r)[1:] for r in choose_parse(spark.createDataFrame(tried, "statement_id long, tier long, ok boolean, ask boolean"), "ask").collect()}
    assert got == {1: (2, False, False, None), 2: (2, False, False, None), 3: (None, False, True, "LLM_UNAVAILABLE"), 4: (None, False, False, "UNSUPPORTED_LAYOUT"), 5: (3, True, False, None), 6: (4, False, False, None)}
