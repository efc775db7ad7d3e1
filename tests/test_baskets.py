from __future__ import annotations

from tillscope import operators as op


def test_co_purchase_counts_lines(lines, products, tuples):
    orders = lines(
        [(1, 1, "1", "2016-01-01", 2, 5), (1, 1, "1", "2016-01-01", 1, 5), (1, 1, "2", "2016-01-01", 4, 7),
         (2, 2, "2", "2016-01-01"), (3, 3, "1", "2016-01-01", 1, 1, "Open")]
    )
    found = op.co_purchase(orders, products((1, "tea", "c", "d"), (2, "jam", "c", "d")), "1")
    assert tuples(found) == [("1", "tea", 2, 3, 10.0), ("2", "jam", 1, 4, 7.0)]


def test_co_purchase_leaves_out_products_missing_from_the_dimension(lines, products, tuples):
    orders = lines([(1, 1, "1", "2016-01-01"), (1, 1, "9", "2016-01-01")])
    found = op.co_purchase(orders, products((1, "tea", "c", "d")), "1")
    assert [r[0] for r in tuples(found)] == ["1"]


def test_quantities_round_halves_to_the_even_number(lines, products, tuples):
    for quantity, whole in ((0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-1.5, -2), (None, None)):
        rows = [(1, 1, "1", "2016-01-01", 1, 5)] + [(1, 1, "2", "2016-01-01", quantity, 5)]
        found = op.co_purchase(lines(rows), products((1, "tea", "c", "d"), (2, "jam", "c", "d")), "1")
        assert [r.quantity_count for r in found.collect() if r.product_id == "2"] == ([whole] if whole is not None else [])


def test_pairs_are_counted_not_produced(lines):
    orders = lines(
        [(1, 1, "A", "2016-01-01"), (1, 1, "A", "2016-01-01", 3), (1, 1, "B", "2016-01-01"),
         (2, 2, "B", "2016-01-01"), (3, 3, "A", "2016-01-01")]
    )
    row, = op.orders_with_pair(orders, "A", "B").collect()
    assert (row.order_id, row.a_lines, row.b_lines, row.a_quantity, row.line_pairs) == (1, 2, 1, 4.0, 2)
    details = op.pair_lines(orders, "A", "B").collect()
    assert sorted((r.product_id, r.partner_lines) for r in details) == [("A", 1), ("A", 1), ("B", 2)]


def test_a_product_paired_with_itself(lines):
    orders = lines([(1, 1, "A", "2016-01-01"), (1, 1, "A", "2016-01-01"), (1, None, "A", "2016-01-01")])
    row, = op.orders_with_pair(orders, "A", "A").collect()
    assert (row.a_lines, row.b_lines, row.line_pairs) == (2, 2, 4)


def test_one_order_holding_most_lines(lines, products):
    rows = [(1, 7, f"{i % 50}", "2016-01-01", 1, 2) for i in range(3000)]
    rows += [(2, 100 + i, f"{i % 50}", "2016-01-01", 1, 2) for i in range(3000)]
    orders = lines(rows)
    dimension = products(*[(i, f"n{i}", "c", "d") for i in range(50)])
    found = {r.product_id: r.order_count for r in op.co_purchase(orders, dimension, "3").collect()}
    assert found == {str(i): 60 + (60 if i == 3 else 0) for i in range(50)}
    pair, = op.orders_with_pair(orders, "1", "2").collect()
    assert pair.line_pairs == 3600
    assert op.pair_lines(orders, "1", "2").count() == 120
