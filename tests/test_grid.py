import random

import pytest

from quillgrid.operators import grid as G
from quillgrid.sources.audit import audit_bounds, within_bounds
from quillgrid.sources.delimited import grid_cells, grid_from_cells


def header_of(make_grid, grid):
    return G.detect_headers(make_grid(grid)).first()


def table_of(grid, merges=None):
    _, records = G.normalise_grid(grid, merges)
    return [r["record"] for r in records.orderBy("file_id", "row_idx").collect()]


def test_plain_header(make_grid):
    h = header_of(make_grid, [["Product ID", "Category", "Unit Price", "Quantity In Stock"], [101, "Hardware", 29.99, 150], [102, "Software", 199.0, 50]])
    assert h["header_row"] == 0 and h["keys"] == ["product_id", "category", "unit_price", "quantity_in_stock"]
    # 0.45 + 0.25 + 0.15 + 0.15 * 0.3 * 6/8
    assert h["confidence"] == 0.88


def test_banner_and_spacer(make_grid):
    grid = [["Quarterly Operations Report", None, None, None], [None] * 4, ["Region", "Manager", "Quota", "Actual"], ["North", "Alice", 100, 120], ["South", "Bob", 90, 85]]
    h = header_of(make_grid, grid)
    assert h["header_row"] == 2 and h["keys"] == ["region", "manager", "quota", "actual"]


def test_header_far_down(make_grid):
    grid = [[f"Note line {i + 1}", None, None] for i in range(15)] + [["Employee ID", "Full Name", "Department"], [1, "John", "Sales"], [2, "Jane", "Ops"]]
    assert header_of(make_grid, grid)["header_row"] == 15


def test_degenerate_grids(make_grid):
    assert header_of(make_grid, [["val"]])["header_row"] == 0
    h = header_of(make_grid, [[None, None], [1, 2]])
    # No row can be a header: the first one serves, and its columns are numbered.
    assert (h["header_row"], h["confidence"], h["original_headers"]) == (0, 0.1, ["Column 1", "Column 2"])
    h = header_of(make_grid, [[]])
    assert (h["confidence"], h["original_headers"], h["keys"], h["active_columns"]) == (0.0, ["Column 1"], ["column_1"], [0])


def test_many_sheets_at_once(make_grid):
    a = [["Report", None], [None, None], ["name", "value"], ["x", 1]]
    b = [["k", "v"], ["y", 2], ["z", 3]]
    found = {r["file_id"]: r["header_row"] for r in G.detect_headers(make_grid(a, b)).collect()}
    assert found == {"f0": 2, "f1": 0}


def test_two_tier_header_with_merges(make_grid, make_merges):
    grid = make_grid([
        ["Location", None, "Q1 Figures", None, None],
        ["Country", "City", "Target", "Actual", "Q1 figures"],
        ["US", "NY", 5, 6, 1],
        ["US", "LA", 7, 8, 2],
    ])
    merges = make_merges((0, 0, 0, 1), (0, 2, 0, 4))
    h = G.detect_headers(G.fill_merges(grid, merges)).first()
    assert h["header_row"] == 1
    assert h["original_headers"] == ["Location Country", "Location City", "Q1 Figures Target", "Q1 Figures Actual", "Q1 figures"]
    assert table_of(grid, merges)[1]["location_city"] == "LA"


def cells_after(grid, merges):
    return [[c["raw"] for c in r["cells"]] for r in G.fill_merges(grid, merges).orderBy("row_idx").collect()]


def test_merges(make_grid, make_merges):
    grid = make_grid([["A", None, "O"], [None, None, "P"], ["x", "y", "z"]])
    assert cells_after(grid, make_merges((0, 0, 1, 1))) == [["A", "A", "O"], ["A", "A", "P"], ["x", "y", "z"]]
    # Outside the grid, or past its edge.
    assert cells_after(grid, make_merges((9, 9, 12, 12), (0, 7, 0, 9), (2, 1, 8, 8)))[2] == ["x", "y", "y"]
    # A later range over earlier ones: its top-left was already filled.
    assert cells_after(grid, make_merges((0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 2, 2))) == [["A", None, "O"], ["A", None, "P"], ["A", "A", "A"]]
    # An empty top-left cell empties the range.
    assert cells_after(grid, make_merges((0, 1, 1, 2))) == [["A", None, None], [None, None, None], ["x", "y", "z"]]


def test_spacer_columns_and_rows(make_grid):
    grid = make_grid([["sku", None, "name", "kind", None], [None] * 5, ["a", None, "b", "k", 5], ["c", None, "d", "l", None]])
    h = G.detect_headers(grid).first()
    assert h["header_row"] == 0 and h["keys"] == ["sku", "name", "kind", "column_5"] and h["active_columns"] == [0, 2, 3, 4]
    assert table_of(grid) == [{"sku": "a", "name": "b", "kind": "k", "column_5": "5"}, {"sku": "c", "name": "d", "kind": "l", "column_5": None}]


def test_noise_rows(make_grid):
    rows = [
        ["Name", "Team", "Pay"], ["Alice", "Sales", 5000], ["Note: checked", None, None], ["Subtotal Sales", None, 9000], ["Bob", "Ops", 6000], ["", "   ", None],
        ["Totally Awesome Inc.", "Ops", 7000], ["Grand Total", None, 22000], ["* as of Q4", None, None], ["a single long remark under the table, no mark", None, None], [None, None, None],
    ]
    got = [(r["name"], r["pay"]) for r in table_of(make_grid(rows))]
    # The subtotal at the end is no footnote, so trimming stops there; the note between data rows stays.
    assert got == [("Alice", "5000"), ("Note: checked", None), ("Bob", "6000"), ("Totally Awesome Inc.", "7000")]


def test_row_flags(make_grid):
    rows = [["Avg deal size", 25], ["Totally fine", 1], ["x" * 59 + " total", 1], ["Sum", 3], ["Source: desk", None], [0, None], ["  ", None]]
    flags = [(r["is_blank"], r["is_subtotal"], r["is_footnote"]) for r in G.row_flags(make_grid(rows), G.F.lit(2)).orderBy("row_idx").collect()]
    assert flags == [(False, True, False), (False, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, False), (True, False, False)]


def test_pipeline(make_grid):
    grid = make_grid([
        ["Financial Report", None, None], ["Quarter", "Revenue", "Operating Cost"], ["Q1", 10000, 7000], [" Q2 ", 12000, 8000], ["Subtotal", None, 15000], ["* Unaudited", None, None],
    ])
    assert table_of(grid) == [{"quarter": "Q1", "revenue": "10000", "operating_cost": "7000"}, {"quarter": "Q2", "revenue": "12000", "operating_cost": "8000"}]


def test_layout_does_not_matter(make_grid):
    rows = [["Title", None], ["a", "b"]] + [[f"r{i}", i] for i in range(60)] + [["Total", 5]]
    grid = make_grid(rows)
    assert table_of(grid.repartition(9)) == table_of(grid.coalesce(1)) and len(table_of(grid)) == 60


def test_cells_and_bounds(make_grid):
    grid = make_grid([["a", None, "c"], [1, 2, 3]])
    again = grid_from_cells(grid_cells(grid).where("raw is not null"))
    assert [[c["raw"] for c in r["cells"]] for r in again.orderBy("row_idx").collect()] == [["a", None, "c"], ["1", "2", "3"]]
    assert audit_bounds(grid).first().asDict() == {
        "file_id": "f0", "sheet": "s", "n_rows": 2, "n_columns": 3, "n_sheets": 1, "too_many_rows": False, "too_many_columns": False, "too_many_sheets": False,
    }
    assert [len(r["cells"]) for r in within_bounds(grid, 1, 2).collect()] == [2]


def plain_merges(cells, merges):
    """Ranges one after another; a range whose top-left cell lies in an earlier one takes that one's value."""
    values, out = {}, [list(row) for row in cells]
    for i, (r0, c0, r1, c1) in enumerate(merges):
        if r0 >= len(cells) or c0 >= len(cells[r0]):
            continue
        inside = [j for j in values if merges[j][0] <= r0 <= merges[j][2] and merges[j][1] <= c0 <= merges[j][3]]
        values[i] = values[max(inside)] if inside and values[max(inside)] is not None else cells[r0][c0]
        for r in range(r0, min(r1, len(cells) - 1) + 1):
            for c in range(c0, min(c1, len(cells[r]) - 1) + 1):
                out[r][c] = values[i]
    return out


def test_merges_of_all_lengths(make_grid, make_merges):
    """Ranges short, long, beyond the sheet and over each other, against filling them one by one."""
    rng = random.Random(4)
    cells = [[f"{r}-{c}" for c in range(rng.randint(1, 5))] for r in range(150)]
    merges = []
    for _ in range(60):
        r0, c0 = rng.randint(0, 160), rng.randint(0, 4)
        merges.append((r0, c0, r0 + rng.choice([-1, 0, 1, 7, 40, 100, 10**9]), c0 + rng.randint(0, 2)))
    merges = [m for m in merges if m[2] >= m[0]]
    assert cells_after(make_grid(cells), make_merges(*merges)) == plain_merges(cells, merges)


def test_a_chain_of_a_thousand_merges(make_grid, make_merges):
    n = 1000
    grid = make_grid([["top", "x"], *[[str(i), "x"] for i in range(1, n + 1)]])
    found = cells_after(grid, make_merges(*[(i, 0, i + 1, 0) for i in range(n)]))
    assert found == [["top", "x"]] * (n + 1)


def test_a_range_over_a_million_rows(spark, make_merges):
    """The range is cut into a few blocks, not into its rows."""
    grid = spark.range(1_000_000).selectExpr("'f0' as file_id", "'s' as sheet", "id as row_idx", "array(named_struct('raw', cast(id as string), 'kind', 'number')) as cells")
    merges = make_merges((10, 0, 2**40, 0))
    blocks = G._covering(grid.select("file_id", "sheet", "row_idx").limit(0), merges)
    assert blocks.count() == 0
    filled = G.fill_merges(grid, merges).where("cells[0].raw = '10'")
    assert filled.count() == 999_990


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_few_ranges_take_one_join(make_grid, make_merges):
    """A sheet with few ranges hands them to its rows by sheet; no row is looked up by its own key."""
    filled = G.fill_merges(make_grid([["A", "B"], [None, "x"], [None, "y"]]), make_merges((0, 0, 2, 0)))
    assert joins_of(filled) == 1
    assert [[c["raw"] for c in r["cells"]] for r in filled.orderBy("row_idx").collect()] == [["A", "B"], ["A", "x"], ["A", "y"]]


def test_sheets_with_few_many_and_chained_ranges(spark, make_grid):
    """Every sheet is filled as if it stood alone, whichever way its ranges go."""
    rng = random.Random(7)
    grids = [[[f"{g}-{r}-{c}" for c in range(4)] for r in range(30)] for g in range(6)]
    ranges = []
    for g, n in enumerate([0, 1, 3, G.FEW_RANGES, G.FEW_RANGES + 1, 40]):
        corners = [(rng.randint(0, 32), rng.randint(0, 3)) for _ in range(n)]
        ranges.append([(r, c, r + rng.choice([0, 1, 4, 50]), c + rng.randint(0, 2)) for r, c in corners])
    merges = spark.createDataFrame(
        [(f"f{g}", "s", i, *m) for g, of_sheet in enumerate(ranges) for i, m in enumerate(of_sheet)],
        "file_id string, sheet string, merge_idx int, start_row bigint, start_col int, end_row bigint, end_col int",
    )
    found = {}
    for r in G.fill_merges(make_grid(*grids), merges).orderBy("file_id", "row_idx").collect():
        found.setdefault(r["file_id"], []).append([c["raw"] for c in r["cells"]])
    assert found == {f"f{g}": plain_merges(cells, ranges[g]) for g, cells in enumerate(grids)}


def test_headers_without_repeats_pass_no_python(make_grid):
    headers = G.detect_headers(make_grid([["name", "value"], ["x", 1]], [["a", "a", None], ["y", 2, 3]], [["p", "q"], ["z", 4]]).where("file_id != 'f1'"))
    assert "ArrowEvalPython" not in headers._jdf.queryExecution().executedPlan().toString()
    # One sheet with repeated keys and a column without label changes nothing for the others.
    both = G.detect_headers(make_grid([["name", "value"], ["x", 1]], [["a", "a", None], ["y", 2, 3]]))
    assert {r["file_id"]: (r["keys"], r["active_columns"]) for r in both.collect()} == {"f0": (["name", "value"], [0, 1]), "f1": (["a", "a_1", "column_3"], [0, 1, 2])}


def test_rows_are_read_once_where_no_sheet_has_notes(make_grid):
    plain = [["name", "value", "day"], ["x", 1, "mon"], ["total", 1, None], ["y", 2, "tue"]]
    noted = [["name", "value", "day"], ["x", 1, "mon"], ["* a note", None, None], ["y", 2, "tue"], ["Source: z", None, None], [None, None, None]]
    _, alone = G.normalise_grid(make_grid(plain))
    assert joins_of(alone) == 1
    _, both = G.normalise_grid(make_grid(plain, noted))
    assert sorted((r["file_id"], r["row_idx"]) for r in both.collect()) == [("f0", 1), ("f0", 3), ("f1", 1), ("f1", 2), ("f1", 3)]


def test_two_rows_with_one_number_are_refused(make_grid):
    grid = make_grid([["name", "value"], ["x", 1]])
    with pytest.raises(Exception, match="two rows with number 0"):
        G.detect_headers(grid.unionByName(grid.where("row_idx = 0")))
