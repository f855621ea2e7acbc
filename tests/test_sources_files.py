"""S1-S5 loaders and the Q4 sink on small files written here."""

import datetime as dt

from tavola.operators import quality as Q
from tavola.sources import io


def test_loaders_are_typed(spark, tmp_path):
    cases = {
        "load_transactions": ("transaction_id,order_id,customer_id,item_id,item_name,category,subcategory,quantity,unit_price,"
                              "total_price,discount_amount,timestamp,order_type,payment_method\n"
                              "t1,1,7,3,Soup,Starters,Hot,2,4.5,9.0,0.0,2024-01-05 12:30:00,dine_in,card\n"
                              "t2,2,,4,Cake,Desserts,Cold,1,5.0,5.0,0.5,2024-01-06 18:00:00,takeout,cash\n", 2),
        "load_customers": ("customer_id,name,email,phone,created_at,loyalty_points,loyalty_tier\n"
                           "7,Ann,a@b.c,1,2023-01-01 00:00:00,120,bronze\n", 1),
        "load_inventory": ("inventory_id,ingredient_name,category,quantity_on_hand,unit,reorder_level,unit_cost,supplier_id\n"
                           "1,Salt,Dry,5,kg,10,1.5,2\n2,Rice,Dry,50,kg,10,2.5,2\n", 2),
    }
    for name, (text, n) in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        df = getattr(io, name)(spark, str(path))
        assert df.count() == n, name
        assert any(t not in ("string",) for _, t in df.dtypes), name


def test_report_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    report = Q.completeness(df, ["id", "v"])
    for _ in range(2):
        Q.append_report(report, str(tmp_path / "reports"))
    back = spark.read.parquet(str(tmp_path / "reports"))
    assert back.count() == 2 * report.count()
    assert isinstance(back.first()["validated_at"], dt.datetime)
