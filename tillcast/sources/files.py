"""Sales uploads: CSV read, header normalisation, alias mapping, defaults,
dataset-level date parsing and upload profiles.

S-01..S-10 (S-26 lives with the providers).

Files are read with every column as a string (no inference pass over the
data); types are applied once the columns have their standard names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DAY_FIRST_FORMATS, ISO_FORMATS, MONTH_FIRST_FORMATS
from ..session import cut_lineage
from . import records as R

STANDARD_COLUMNS = ("date", "item_name", "quantity", "size", "type", "unit_price", "total_price",
                    "order_id", "time", "location", "employee_id", "payment_method", "notes", "cost")

# Column name aliases -> standard names (file headers are
# lower-cased, trimmed and spaces turned into '_' before the lookup).
COLUMN_ALIASES = {
    "order_date": "date", "sale_date": "date", "transaction_date": "date", "order date": "date",
    "sale date": "date", "trans_date": "date", "day": "date", "sold_on": "date",
    "pizza_name": "item_name", "product": "item_name", "product_name": "item_name", "item": "item_name",
    "name": "item_name", "product name": "item_name", "menu_item": "item_name",
    "item_description": "item_name", "description": "item_name",
    "pizza_size": "size", "product_size": "size", "item_size": "size", "portion": "size",
    "portion_size": "size", "variant": "size", "oz": "size", "volume": "size",
    "pizza_category": "type", "pizza_type": "type", "product_type": "type", "item_type": "type",
    "category": "type", "product_category": "type", "item_category": "type", "food_type": "type",
    "menu_category": "type", "group": "type", "department": "type", "class": "type",
    "price": "unit_price", "item_price": "unit_price", "product_price": "unit_price",
    "sale_price": "unit_price", "selling_price": "unit_price", "retail_price": "unit_price",
    "price_each": "unit_price", "each_price": "unit_price", "pizza_price": "unit_price",
    "item_cost": "cost", "product_cost": "cost", "unit_cost": "cost",
    "total_price": "total_price", "total": "total_price", "revenue": "total_price",
    "amount_paid": "total_price", "order_total": "total_price", "line_total": "total_price",
    "subtotal": "total_price", "sales": "total_price", "income": "total_price", "sale_amount": "total_price",
    "order": "order_id", "transaction_id": "order_id", "receipt": "order_id", "ticket": "order_id",
    "order_details_id": "order_id", "invoice": "order_id", "invoice_id": "order_id", "receipt_id": "order_id",
    "qty": "quantity", "amount": "quantity", "units": "quantity", "units_sold": "quantity",
    "qty_sold": "quantity", "order_qty": "quantity", "order_quantity": "quantity", "count": "quantity",
    "num_sold": "quantity", "sold": "quantity",
    "order_time": "time", "sale_time": "time", "transaction_time": "time", "time_of_sale": "time",
    "timestamp": "time", "hour": "time",
    "store": "location", "branch": "location", "site": "location", "outlet": "location",
    "employee": "employee_id", "staff": "employee_id", "server": "employee_id", "cashier": "employee_id",
    "sold_by": "employee_id",
    "payment": "payment_method", "payment_type": "payment_method", "tender": "payment_method",
    "pay_type": "payment_method",
    "comments": "notes", "remarks": "notes", "memo": "notes", "pizza_ingredients": "notes",
}

CORRUPT = "_corrupt_record"
BROADCAST_TEXTS = 100_000  # distinct date texts that go to the rows; beyond it both sides are shuffled
NUMERIC_COLUMNS = {"quantity": "double", "unit_price": "double", "total_price": "double", "cost": "double"}


def read_csv_checked(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """S-01: header CSV, one or many files / globs, every column a string.

    Returns (rows, rejects): quoted fields may hold doubled quotes and line
    breaks; rows that do not fit their file's header come back as rejects with
    their raw text in ``_corrupt_record``. Files are read by their own header:
    another order of columns is no difference, a column that a file lacks is
    NULL. Large files are read by many tasks (``sources.records``).
    """
    parts = [read_one_layout(spark, header, files) for header, files in R.layouts(spark, paths)]
    return _united([p[0] for p in parts]), _united([p[1] for p in parts])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_one_layout(spark: SparkSession, header: Sequence[str], files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of files with one header."""
    if CORRUPT in header:
        raise ValueError(f"an upload column is named {CORRUPT}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(CORRUPT, T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    # as a generator, a record is parsed once: neither the filter nor a column repeats it
    rows = R.records(spark, files).select(F.inline(F.array(F.from_csv("record", _ddl(schema), options))))
    bad = F.col(CORRUPT).isNotNull()
    return rows.where(~bad).drop(CORRUPT), rows.where(bad)


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)


def read_sales_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """S-01: the rows of ``read_csv_checked``."""
    return read_csv_checked(spark, paths)[0]


def normalize_header(name: str, spaces_to_underscore: bool = True) -> str:
    n = name.strip().lower()
    return re.sub(" ", "_", n) if spaces_to_underscore else n


def normalize_headers(df: DataFrame, spaces_to_underscore: bool = True) -> DataFrame:
    """S-02: lower-case and trim headers (and spaces -> '_', Q2b). A header
    that collides with an earlier one gets a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normalize_header(c, spaces_to_underscore)
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 1
        names.append(n)
    return df.toDF(*names)


def resolve_mapping(columns: Iterable[str], mapping: dict | None = None) -> dict[str, str]:
    """Column -> standard name. Two columns aiming at one standard name (Q2):
    the column already named so wins, else the first in file order; the
    others keep their own names."""
    mapping = COLUMN_ALIASES if mapping is None else mapping
    cols = list(columns)
    out: dict[str, str] = {}
    taken = {c for c in cols if c in STANDARD_COLUMNS}
    for c in cols:
        target = mapping.get(c)
        if target is None or c == target:
            continue
        if target in taken:
            continue
        out[c] = target
        taken.add(target)
    return out


def apply_column_mapping(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """S-03: rename alias columns to the standard names."""
    return df.withColumnsRenamed(resolve_mapping(df.columns, mapping))


def alias_table(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """(alias, standard) rows, each standard name also its own alias."""
    mapping = COLUMN_ALIASES if mapping is None else mapping
    rows = [(a, s) for a, s in mapping.items()] + [(s, s) for s in STANDARD_COLUMNS if s not in mapping]
    return spark.createDataFrame(rows, "alias string, standard string")


def suggest_mapping(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """S-04: for a catalogue (file, column) of many uploads, column -> standard
    name. Aliases are a fixed ~120-row table, broadcast."""
    return catalogue.join(F.broadcast(aliases), catalogue["column"] == aliases["alias"]).select(
        "file", "column", "standard")


def relevant_mapping(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """S-05: the alias rows that apply to each file."""
    cols = catalogue.select("file", F.col("column").alias("alias")).distinct()
    return cols.join(F.broadcast(aliases), "alias").select("file", "alias", "standard")


def unmapped_theirs(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """S-06: columns of each file that map to nothing."""
    return catalogue.join(F.broadcast(aliases), catalogue["column"] == aliases["alias"], "left_anti")


def unmapped_ours(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """S-06: standard names that no column of the file maps to."""
    files = catalogue.select("file").distinct()
    wanted = files.select("file", F.explode(F.array(*[F.lit(s) for s in STANDARD_COLUMNS])).alias("standard"))
    got = suggest_mapping(catalogue, aliases).select("file", "standard").distinct()
    return wanted.join(got, ["file", "standard"], "left_anti")


def profile_upload(df: DataFrame, preview_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """S-07: (one-row summary: row count and column names, preview of the
    first rows as strings with NULL / NaN -> ''). The preview limit is the feature."""
    summary = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
    preview = df.limit(preview_rows).select(*[
        F.when(F.col(c).cast("string").isin("NaN", "nan", "NaT"), F.lit("")).otherwise(
            F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    return summary, preview


def default_columns(df: DataFrame) -> DataFrame:
    """S-08: without ``item_name``, the first text column (not all values
    numeric) becomes it unless that column is ``date``, else 'All Items';
    without ``quantity``, every row counts 1.

    Which column is 'text' is schema-level metadata: one aggregate row of
    per-column flags is computed (one pass) and read on the driver.
    """
    out = df
    if "item_name" not in df.columns:
        cand = [c for c in df.columns]
        if cand:
            flags = df.agg(*[F.max(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), 1)
                                   .otherwise(0)).alias(f"_t{i}") for i, c in enumerate(cand)]).first()
            text = [c for i, c in enumerate(cand) if flags[f"_t{i}"] == 1]
        else:
            text = []
        if text and text[0] != "date":
            out = out.withColumnRenamed(text[0], "item_name")
        else:
            out = out.withColumn("item_name", F.lit("All Items"))
    if "quantity" not in out.columns:
        out = out.withColumn("quantity", F.lit(1.0))
    return out


def parse_sales_dates(df: DataFrame, col: str = "date", day_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """S-09 (Q1): ISO text is always year-month-day. For slash dates the order
    is chosen once per dataset: if some values only fit day-first (first field
    > 12) and none only fit month-first, the data is day-first, and vice versa;
    otherwise ``day_first`` decides. A layout that does not fit costs an
    exception inside Spark, so each distinct text is read once, not each row:
    the texts with their readings are a table that the rows are joined with and
    that the choice is an aggregate of. Returns (parsed rows, rejected rows)."""
    t = F.trim(F.col(col).cast("string"))

    def any_of(fmts):
        return F.coalesce(*[F.try_to_timestamp("_text", F.lit(f)) for f in fmts]).cast("date")

    texts = df.select(t.alias("_text")).where(F.col("_text").isNotNull()).distinct()
    dates = cut_lineage(texts.select("_text", any_of(ISO_FORMATS).alias("_iso"), any_of(DAY_FIRST_FORMATS).alias("_df"),
                                     any_of(MONTH_FIRST_FORMATS).alias("_mf")), "dates")
    votes = dates.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("_iso").isNull() & F.col("_df").isNotNull() & F.col("_mf").isNull()).alias("only_df"),
        F.count_if(F.col("_iso").isNull() & F.col("_mf").isNotNull() & F.col("_df").isNull()).alias("only_mf")).first()
    if (votes.only_df > 0) != (votes.only_mf > 0):
        day_first = votes.only_df > 0
    order = ("_iso", "_df", "_mf") if day_first else ("_iso", "_mf", "_df")
    parsed = dates.select("_text", F.coalesce(*order).alias("_parsed"))
    parsed = F.broadcast(parsed) if votes.texts <= BROADCAST_TEXTS else parsed.hint("shuffle_hash")
    out = df.withColumn("_text", t).join(parsed, "_text", "left").select(*df.columns, "_parsed")
    good = out.where(F.col("_parsed").isNotNull()).withColumn(col, F.col("_parsed")).drop("_parsed")
    bad = out.where(F.col("_parsed").isNull()).drop("_parsed")
    return good, bad


def to_canonical(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed SALES columns; absent standard columns become typed NULLs, numbers
    are parsed with ``try_cast`` (bad values -> NULL, never an error)."""
    cols = []
    for c in STANDARD_COLUMNS:
        if c == "date":
            cols.append((F.col(c).cast("date") if c in df.columns else F.lit(None).cast("date")).alias(c))
        elif c in NUMERIC_COLUMNS:
            cols.append((F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c))
        else:
            cols.append((F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c))
    return df.select(*[F.col(k) for k in keep], *cols)


def load_sales(spark: SparkSession, paths, day_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """S-01 -> S-02 -> S-03 -> S-08 -> S-09 -> typed SALES; returns (sales, rejects).

    Every layout among the files is normalised and mapped by its own header
    (S-02, S-03), then they are united by standard names. The order of day and
    month is one choice for the whole dataset."""
    mapped = [apply_column_mapping(normalize_headers(read_one_layout(spark, header, files)[0]))
              for header, files in R.layouts(spark, paths)]
    good, bad = parse_sales_dates(_united([default_columns(m) for m in mapped]), "date", day_first)
    return to_canonical(good), bad
