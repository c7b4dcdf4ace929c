"""What the joins of a plan send to every task."""

from pyspark.sql import functions as F

from tallyloom.operators import lookup, prior_return
from tallyloom.plans import prior


def broadcast(df):
    """The operators below each broadcast of a plan."""
    found, open_ = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        open_ = [d for d in open_ if d < depth]
        if open_:
            found.append(line)
        if "BroadcastExchange" in line:
            open_.append(depth)
    return found


def test_grams_are_dealt_out(spark):
    texts = spark.range(50).select(F.concat(F.lit("net worth of "), F.col("id").cast("string")).alias("text"))
    met = lookup.contained(spark.createDataFrame([("net worth",), ("wo",), ("tax",)], "text string"), texts, 5)
    assert met.count() == 100
    assert not [x for x in broadcast(met) if "Generate" in x]


def test_cells_against_a_template_are_dealt_out(spark):
    sf = "/root/testdata/sf0.001"
    cells = spark.createDataFrame([(s, r, c, v) for s, rows in prior.TEMPLATE.items() for r, line in rows.items() for c, v in enumerate(line)], "sheet string, row_no int, col_no int, value string")
    made = prior_return.against_template(cells, prior_return.prior_fields(prior.prior_texts(spark, sf)), prior.grid_cells(spark, sf))
    assert not [x for x in broadcast(made) if "customer.parquet" in x]
