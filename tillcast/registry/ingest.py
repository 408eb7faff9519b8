"""Registered queries: CSV uploads round-tripped through the shared folder.

S-01..S-03, S-07..S-09, S-26. The sales view is written as an upload with
the header names a shop export would use, then read back through the full
ingestion path and compared with the view itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import scalars as X
from ..operators import series as S
from ..session import cut_lineage, scratch_path
from ..sources import files as FL
from ..sources import providers as P
from ..sources import tables as T
from . import query

_SALES = T.with_ctes(T.SALES_SQL)


def _upload(spark, sf_dir, date_format: str) -> str:
    """S-26: write the sales view as a shop-style CSV export; returns its path."""
    s = T.sales(spark, sf_dir)
    export = s.select(
        F.date_format("date", date_format).alias("Order Date"), F.col("item_name").alias("Product Name"),
        F.col("quantity").alias("Qty"), F.col("size").alias("Pizza Size"), F.col("type").alias("Category"),
        F.col("unit_price").alias("Price"), F.col("total_price").alias("Total"),
        F.col("order_id").alias("Order"), F.col("business_id").alias(" Store "))
    path = scratch_path(spark, "upload")
    P.write_sales_csv(export, path)
    return path


def _roundtrip(spark, sf_dir, date_format: str):
    path = _upload(spark, sf_dir, date_format)
    sales, _rejects = FL.load_sales(spark, path, day_first=True)
    return sales.select(F.col("location").cast("long").alias("business_id"), "date", "item_name", "quantity",
                        "size", "type", "unit_price", "total_price", "order_id")


_RT_SQL = _SALES + """
SELECT business_id, date, item_name, quantity, size, type, unit_price, total_price, order_id FROM sales"""


@query("S01_S02_S03_S09_S26_csv_roundtrip", _RT_SQL)
def csv_roundtrip_day_first(spark, sf_dir):
    """dd/MM/yyyy export: header normalisation, alias mapping, day-first dates."""
    return _roundtrip(spark, sf_dir, "dd/MM/yyyy")


@query("S01_S26_text_roundtrip", """
SELECT doc_id, text, source FROM documents""")
def csv_text_roundtrip(spark, sf_dir):
    """Texts with quotes, commas and line breaks survive export and upload."""
    docs = T.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "upload-text")
    P.write_sales_csv(docs, path)
    rows = FL.read_sales_csv(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


@query("S01_S03_many_layouts", _SALES + """
SELECT CAST(business_id AS VARCHAR) AS location, date, item_name, quantity, size,
       CASE WHEN business_id % 3 <> 2 THEN type END AS type, unit_price, total_price, order_id
FROM sales""")
def many_layouts(spark, sf_dir):
    """Uploads of different shops in one load: two orders of columns under different names, and one without a category."""
    s = T.sales(spark, sf_dir)
    path = scratch_path(spark, "upload-layouts")
    day = F.date_format("date", "yyyy-MM-dd")
    one = [day.alias("Order Date"), F.col("item_name").alias("Product Name"), F.col("quantity").alias("Qty"), F.col("size").alias("Pizza Size"),
           F.col("type").alias("Category"), F.col("unit_price").alias("Price"), F.col("total_price").alias("Total"),
           F.col("order_id").alias("Order"), F.col("business_id").alias("Store")]
    two = [F.col("item_name").alias("ITEM"), F.col("type").alias("Item Type"), F.col("order_id").alias("receipt"), F.col("business_id").alias("branch"),
           F.col("total_price").alias("Revenue"), F.col("unit_price").alias("item price"), F.col("quantity").alias("units"), F.col("size").alias("portion"),
           day.alias("Sold On")]
    for k, columns in enumerate((one, two, [c for c in one if c is not one[4]])):
        P.write_sales_csv(s.where(F.col("business_id") % 3 == k).select(*columns), f"{path}/{k}")
    return FL.load_sales(spark, f"{path}/*")[0].select("location", "date", "item_name", "quantity", "size", "type", "unit_price", "total_price", "order_id")


@query("S01_one_large_file", """
SELECT doc_id, text, TRUE AS by_many_tasks FROM documents""")
def one_large_file(spark, sf_dir):
    """All texts as one quoted file with line breaks inside its fields, read back by more than one task. A file is
    written by one task: beyond ``FILE_BYTES`` of text there are more files, each of which many tasks read."""
    docs = T.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "upload-large")
    files = _files_for(docs.agg(F.sum(F.octet_length("text"))).first()[0])
    P.write_sales_csv(docs.repartition(files) if files > 1 else docs.coalesce(1), path)
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(4096, size // 16)))  # as a larger file would be cut
    try:
        rows = FL.read_sales_csv(spark, path)
        tagged = cut_lineage(rows.withColumn("part", F.spark_partition_id()), "large-file")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parts = tagged.agg(F.count_distinct("part")).first()[0]
    return tagged.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(parts > files).alias("by_many_tasks"))


FILE_BYTES = 1 << 28  # of text that one task writes as a file


def _files_for(size: int | None) -> int:
    return max(1, -(-(size or 0) // FILE_BYTES))


@query("S01_rejected_rows", """
SELECT COUNT(*) AS good, COUNT(*) AS rejected FROM orders""")
def csv_rejects(spark, sf_dir):
    """Every order once as a sound line and once with a field too many."""
    o = T.read_table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.concat(F.lit('"'), "o_orderstatus", F.lit(' ""x"""')))
    path = scratch_path(spark, "upload-bad")
    lines = o.select(line.alias("value")).unionByName(o.select(F.concat(line, F.lit(",surplus")).alias("value")))
    # the header stands in a file of its own layout: every part file gets one
    lines.selectExpr("value as `o_orderkey,o_custkey,o_orderstatus`").write.option("header", True).option("quote", "\u0000").option(
        "escapeQuotes", False).option("delimiter", "\u0001").csv(path)
    good, bad = FL.read_csv_checked(spark, path)
    counted = good.select(F.lit(1).alias("g"), F.lit(0).alias("b"), "o_orderkey").unionByName(
        bad.select(F.lit(0).alias("g"), F.lit(1).alias("b"), "o_orderkey"))
    return counted.agg(F.sum("g").alias("good"), F.sum("b").alias("rejected"))


@query("S09_parse_dates_month_first", _RT_SQL)
def csv_roundtrip_month_first(spark, sf_dir):
    """MM/dd/yyyy export read with the default day_first=True: the dataset vote
    sees values that only fit month-first and reads every date month-first."""
    return _roundtrip(spark, sf_dir, "MM/dd/yyyy")


@query("S07_profile_upload", _SALES + "SELECT COUNT(*) AS row_count, 9 AS column_count FROM sales")
def profile_upload(spark, sf_dir):
    raw = FL.normalize_headers(FL.read_sales_csv(spark, _upload(spark, sf_dir, "yyyy-MM-dd")))
    summary, _preview = FL.profile_upload(raw)
    return summary.select("row_count", F.size("columns").alias("column_count"))


@query("S08_default_columns", _SALES + """
SELECT date, item_name, CAST(COUNT(*) AS DOUBLE) AS quantity FROM sales GROUP BY date, item_name""")
def default_columns(spark, sf_dir):
    """An export with no item or quantity column: the first text column
    ('brand') becomes the item and every row counts 1."""
    s = T.sales(spark, sf_dir)
    path = scratch_path(spark, "upload-min")
    P.write_sales_csv(s.select(F.col("item_name").alias("Brand"), F.date_format("date", "yyyy-MM-dd").alias("Day"),
                               F.col("unit_price").alias("Price")), path)
    sales, _ = FL.load_sales(spark, path)
    return S.daily_item_sales(sales.select("date", "item_name", "quantity"))


@query("S10_rejected_dates", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'soon' END AS text
FROM orders WHERE o_orderkey % 3 < 2""")
def rejected_dates(spark, sf_dir):
    """Order dates, two thirds of them in layouts that are no date here: those are rejected."""
    o = T.read_table(spark, sf_dir, "orders")
    text = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
            .when(F.col("o_orderkey") % 3 == 1, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return DT.dated(o.select("o_orderkey", text.alias("text")), "text")[1]


_ALIASES = sorted({**FL.COLUMN_ALIASES, **{s: s for s in FL.STANDARD_COLUMNS if s not in FL.COLUMN_ALIASES}}.items())
_CATALOGUE_SQL = "WITH al(pos, alias, standard) AS (VALUES " + ", ".join(
    f"({i + 1}, '{a}', '{s}')" for i, (a, s) in enumerate(_ALIASES)) + f"""),
catalogue AS (
  SELECT o_custkey AS file, COALESCE(alias, 'field_' || CAST(o_orderkey AS VARCHAR)) AS "column"
  FROM orders LEFT JOIN al ON pos = o_orderkey % {len(_ALIASES) + 9} + 1),
std(standard) AS (SELECT unnest([{", ".join(f"'{s}'" for s in FL.STANDARD_COLUMNS)}]))
"""


def _catalogue(spark, sf_dir):
    """Every customer's orders as the columns of one upload: known headers and unknown ones."""
    names = F.array(*[F.lit(a) for a, _ in _ALIASES])
    at = (F.col("o_orderkey") % (len(_ALIASES) + 9) + 1).cast("int")
    column = F.coalesce(F.get(names, at - 1), F.concat(F.lit("field_"), F.col("o_orderkey").cast("string")))
    return T.read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), column.alias("column"))


@query("S04_suggest_mapping", _CATALOGUE_SQL + """SELECT file, "column", standard FROM catalogue JOIN al ON alias = "column\"""")
def suggest_mapping(spark, sf_dir):
    return FL.suggest_mapping(_catalogue(spark, sf_dir), FL.alias_table(spark))


@query("S05_relevant_mapping", _CATALOGUE_SQL + """SELECT DISTINCT file, alias, standard FROM catalogue JOIN al ON alias = "column\"""")
def relevant_mapping(spark, sf_dir):
    return FL.relevant_mapping(_catalogue(spark, sf_dir), FL.alias_table(spark))


@query("S06_unmapped_theirs", _CATALOGUE_SQL + """SELECT file, "column" FROM catalogue WHERE "column" NOT IN (SELECT alias FROM al)""")
def unmapped_theirs(spark, sf_dir):
    return FL.unmapped_theirs(_catalogue(spark, sf_dir), FL.alias_table(spark))


@query("S06_unmapped_ours", _CATALOGUE_SQL + """SELECT file, s.standard FROM (SELECT DISTINCT file FROM catalogue) AS f, std AS s
WHERE NOT EXISTS (SELECT 1 FROM catalogue c JOIN al ON al.alias = c."column" WHERE c.file = f.file AND al.standard = s.standard)""")
def unmapped_ours(spark, sf_dir):
    return FL.unmapped_ours(_catalogue(spark, sf_dir), FL.alias_table(spark))


@query("F24_business_type", "SELECT c_custkey, lower(c_mktsegment) AS btype, lower(c_mktsegment) IN ("
       + ", ".join(f"'{b}'" for b in X.BUSINESS_TYPES) + ") AS valid FROM customer")
def business_type(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("btype"))
    return c.withColumn("valid", X.valid_business_type("btype"))


@query("S07_upload_preview", "SELECT o_orderkey AS order_key, COALESCE(o_orderstatus, '') AS status FROM orders ORDER BY o_orderkey LIMIT 5")
def upload_preview(spark, sf_dir):
    """The preview of an upload: its first rows (limit = the feature) as text."""
    o = T.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"))
    return FL.profile_upload(o.orderBy("order_key"))[1].withColumn("order_key", F.col("order_key").cast("long"))


@query("S10_safe_parse_date", _SALES + """,
txt AS (
  SELECT DISTINCT date, f, CASE f WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%d/%m/%Y')
    WHEN 2 THEN strftime(date, '%m/%d/%Y') ELSE strftime(date, '%Y/%m/%d') END AS text
  FROM sales, range(0, 4) t(f)
)
SELECT date, CAST(f AS INTEGER) AS f, ' ' || text || ' ' AS text,
  CAST(COALESCE(try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%d/%m/%Y'), try_strptime(text, '%m/%d/%Y'),
                try_strptime(text, '%Y/%m/%d')) AS DATE) AS parsed
FROM txt""")
def safe_parse_date(spark, sf_dir):
    """Every sales date written in four layouts (padded with spaces) and read
    back with the fixed fallback order Y-m-d, d/m/Y, m/d/Y, Y/m/d."""
    from ..functions.dates import safe_parse_date as spd

    d = T.sales(spark, sf_dir).select("date").distinct()
    fmts = F.array(*[F.lit(x) for x in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")])
    t = d.select("date", F.posexplode(fmts).alias("f", "fmt"))
    t = t.select("date", F.col("f").cast("int").alias("f"),
                 F.concat(F.lit(" "), F.expr("date_format(date, fmt)"), F.lit(" ")).alias("text"))
    return t.select("date", "f", "text", spd("text").alias("parsed"))


@query("S28_write_predictions", T.with_ctes(*T.PRED_CTES) + """
SELECT model_id, prediction_date, item_name, predicted_quantity, actual_quantity FROM predictions""")
def write_predictions(spark, sf_dir):
    """Predictions persisted as a Parquet table partitioned by model, read back."""
    daily = T.daily_series(spark, sf_dir)
    from ..operators.merges import write_table

    path = scratch_path(spark, "predictions-table")
    write_table(T.predictions(spark, sf_dir, daily), path, ["model_id"])
    back = spark.read.parquet(path)
    return back.select(F.col("model_id").cast("long").alias("model_id"), "prediction_date", "item_name",
                       "predicted_quantity", "actual_quantity")


@query("F21_null_nonfinite", """
SELECT l_orderkey, l_linenumber,
  ROUND(CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END, 6) AS x,
  (isnan(y) OR isinf(y)) AS y_is_null,
  CAST((CASE WHEN isnan(x) OR isinf(x) THEN 1 ELSE 0 END) + (CASE WHEN isnan(y) OR isinf(y) THEN 1 ELSE 0 END)
       AS INTEGER) AS array_nulls
FROM (SELECT l_orderkey, l_linenumber, sqrt(l_quantity - 25.5) AS x, exp(l_quantity * 20) AS y FROM lineitem)""")
def null_nonfinite(spark, sf_dir):
    """F-21 on values derived from every line item: sqrt of (quantity - 25.5)
    is NaN below 25.5, exp(20 x quantity) overflows to +Inf from 36 on; both
    become NULL in scalar and in array columns."""
    from ..util import null_nonfinite as nnf

    li = T.read_table(spark, sf_dir, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber", F.sqrt(F.col("l_quantity") - 25.5).alias("x"),
                    F.exp(F.col("l_quantity") * 20).alias("y"))
    raw = raw.withColumn("arr", F.array("x", "y"))
    clean = nnf(raw)
    return clean.select("l_orderkey", "l_linenumber", (F.round("x", 6) + F.lit(0.0)).alias("x"),
                        F.col("y").isNull().alias("y_is_null"),
                        F.size(F.filter("arr", lambda v: v.isNull())).alias("array_nulls"))


@query("F27_line_measures", """
SELECT l_orderkey, l_linenumber, rev AS line_revenue, cost AS line_cost, round_even(rev - cost, 2) AS gross_margin
FROM (
  SELECT l_orderkey, l_linenumber,
    round_even(up * q, 2) AS rev, round_even(uc * q, 2) AS cost
  FROM (
    SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_quantity AS INTEGER) AS q,
      CAST(round(p.p_retailprice * 100) AS BIGINT) / 100 AS up,
      round_even(CAST(round(p.p_retailprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT))
                 / 100, 0) / 100 AS uc
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey))""")
def line_measures(spark, sf_dir):
    """F-27 on every line item: unit price = the part's price, unit cost = the
    discounted price in whole cents; revenue, cost and margin rounded to 2."""
    from ..functions.scalars import line_measures as lm

    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                        "l_discount")
    part = T.read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    pct = F.round(F.col("l_discount") * 100).cast("long")
    unit_cost = F.bround(cents * (100 - pct) / 100, 0) / 100
    m = lm(cents / 100, unit_cost, F.col("l_quantity").cast("int"))
    return j.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in m.items()])
