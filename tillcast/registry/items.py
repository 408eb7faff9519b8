"""Registered queries: item profiles, hourly patterns, lookups, size expansion.

A-05..A-11, A-13..A-15, J-13, J-21..J-23, P-01..P-04, F-26.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import items as I
from ..operators import series as S
from ..plans import features as FE
from ..plans import forecast as FC
from ..sources import tables as T
from ..session import cut_lineage
from ..util import round_doubles
from . import query

_BASE = T.with_ctes(T.SALES_SQL, T.daily_sales_sql())

_CAT_SQL = """,
cat AS (
  SELECT business_id, item_name, type AS category FROM (
    SELECT business_id, item_name, type,
           row_number() OVER (PARTITION BY business_id, item_name ORDER BY date, order_id, type) AS rn
    FROM sales WHERE type IS NOT NULL AND item_name IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT DISTINCT business_id, item_name, 'Other' FROM sales s
  WHERE item_name IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM sales t WHERE t.business_id = s.business_id AND t.item_name = s.item_name
    AND t.type IS NOT NULL)
)"""


@query("A06_item_category", _BASE.rstrip() + _CAT_SQL + "\nSELECT business_id, item_name, category FROM cat")
def item_category(spark, sf_dir):
    return I.item_category(T.sales(spark, sf_dir))


@query("A05_category_average", _BASE.rstrip() + _CAT_SQL + """
SELECT d.business_id, COALESCE(c.category, 'Other') AS category, ROUND(AVG(d.quantity), 6) AS category_avg
FROM daily d LEFT JOIN cat c ON d.business_id = c.business_id AND d.item_name = c.item_name
GROUP BY ALL""")
def category_average(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    return round_doubles(I.category_average(T.daily_series(spark, sf_dir), I.item_category(sales)))


@query("A07_item_sizes", _BASE + """
SELECT DISTINCT business_id, item_name, size FROM sales WHERE size IS NOT NULL AND item_name IS NOT NULL""")
def item_sizes(spark, sf_dir):
    sizes = I.item_sizes(T.sales(spark, sf_dir))
    return sizes.select("business_id", "item_name", F.explode("sizes").alias("size"))


@query("A08_primary_size", _BASE + """
SELECT business_id, item_name, size AS primary_size FROM (
  SELECT business_id, item_name, size,
         row_number() OVER (PARTITION BY business_id, item_name ORDER BY COUNT(*) DESC, size) AS rn
  FROM sales WHERE size IS NOT NULL AND item_name IS NOT NULL GROUP BY business_id, item_name, size)
WHERE rn = 1""")
def primary_size(spark, sf_dir):
    return I.primary_size(T.sales(spark, sf_dir))


@query("A09_size_distribution", _BASE + """,
ps AS (SELECT business_id, item_name, size, COALESCE(SUM(quantity), 0) AS q
       FROM sales WHERE item_name IS NOT NULL GROUP BY ALL),
tot AS (SELECT *, SUM(q) OVER (PARTITION BY business_id, item_name) AS total FROM ps)
SELECT business_id, item_name, size, ROUND(q / total, 6) AS share FROM tot
WHERE size IS NOT NULL AND total > 0""")
def size_distribution(spark, sf_dir):
    return round_doubles(I.size_distribution(T.sales(spark, sf_dir)))


@query("A10_size_prices", _BASE + """
SELECT business_id, item_name, size, ROUND(AVG(unit_price), 6) AS size_price
FROM sales WHERE size IS NOT NULL AND item_name IS NOT NULL GROUP BY ALL HAVING AVG(unit_price) IS NOT NULL""")
def size_prices(spark, sf_dir):
    return round_doubles(I.size_prices(T.sales(spark, sf_dir)))


@query("A11_price_stats", _BASE + """
SELECT business_id, item_name, ROUND(AVG(unit_price), 6) AS unit_price, ROUND(MIN(unit_price), 6) AS min_price,
       ROUND(MAX(unit_price), 6) AS max_price
FROM sales WHERE item_name IS NOT NULL AND unit_price IS NOT NULL GROUP BY ALL""")
def price_stats(spark, sf_dir):
    return round_doubles(I.price_stats(T.sales(spark, sf_dir)))


@query("A13_category_index", _BASE.rstrip() + _CAT_SQL + """
SELECT business_id, category, CAST(row_number() OVER (PARTITION BY business_id, category ORDER BY item_name)
       AS INTEGER) AS pos, item_name FROM cat""")
def category_index(spark, sf_dir):
    return I.category_index(I.item_category(T.sales(spark, sf_dir)))


@query("A14_A15_hourly_patterns", T.with_ctes(T.TIMED_SALES_SQL) + """,
h AS (SELECT business_id, item_name, CAST(hour(strptime(time, '%H:%M')) AS INTEGER) AS hour, quantity
      FROM timed_sales WHERE item_name IS NOT NULL),
g AS (
  SELECT business_id, item_name AS scope, hour, COALESCE(SUM(quantity), 0) AS s,
         CAST(COUNT(quantity) AS BIGINT) AS count, AVG(quantity) AS mean FROM h GROUP BY business_id, item_name, hour
  UNION ALL
  SELECT business_id, '_overall', hour, COALESCE(SUM(quantity), 0), CAST(COUNT(quantity) AS BIGINT), AVG(quantity)
  FROM h GROUP BY business_id, hour
)
SELECT business_id, scope, hour, ROUND(s, 6) AS sum, count, ROUND(mean, 6) AS mean,
  CASE WHEN SUM(s) OVER (PARTITION BY business_id, scope) > 0
       THEN round_even(s / SUM(s) OVER (PARTITION BY business_id, scope) * 100, 1) ELSE 0.0 END AS percentage
FROM g""")
def hourly_patterns(spark, sf_dir):
    return round_doubles(I.hourly_patterns(T.timed_sales(spark, sf_dir)))


# ------------------------------------------------------------ lookups

def _lookup_names(sales):
    """Names to look up, derived from the sales rows: the item itself, a
    shortened name, the name with its type's first word, and the bare type."""
    s = sales.where(F.col("item_name").isNotNull())
    variants = F.array(F.col("item_name"), F.substring("item_name", 1, 7),
                       F.concat(F.lower("item_name"), F.lit(" "), F.split("type", " ")[0]), F.col("type"))
    return s.select("business_id", F.explode(variants).alias("name")).where(F.col("name").isNotNull()).distinct()


_NAMES_SQL = """,
names AS (
  SELECT DISTINCT business_id, name FROM (
    SELECT business_id, item_name AS name FROM sales WHERE item_name IS NOT NULL
    UNION ALL SELECT business_id, substring(item_name, 1, 7) FROM sales WHERE item_name IS NOT NULL
    UNION ALL SELECT business_id, lower(item_name) || ' ' || split_part(type, ' ', 1) FROM sales
              WHERE item_name IS NOT NULL AND type IS NOT NULL
    UNION ALL SELECT business_id, type FROM sales WHERE item_name IS NOT NULL) WHERE name IS NOT NULL
),
cand AS (
  SELECT n.business_id, n.name, k.item_name, k.category,
         abs(length(k.item_name) - length(n.name)) AS d
  FROM names n JOIN cat k ON n.business_id = k.business_id AND length(n.name) > 0
   AND (contains(lower(k.item_name), lower(n.name)) OR contains(lower(n.name), lower(k.item_name)))
),
sim AS (
  SELECT business_id, name, item_name AS similar_item, category AS similar_category FROM (
    SELECT *, row_number() OVER (PARTITION BY business_id, name ORDER BY d, category, item_name) AS rn FROM cand)
  WHERE rn = 1
)"""


@query("J22_similar_items", _BASE.rstrip() + _CAT_SQL + _NAMES_SQL + """
SELECT business_id, name, similar_item, similar_category FROM sim""")
def similar_items(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    return I.similar_items(_lookup_names(sales), I.item_category(sales))


@query("J21_item_code_lookup", _BASE.rstrip() + _CAT_SQL + _NAMES_SQL + """,
codes AS (SELECT business_id, item_name, CAST(row_number() OVER (PARTITION BY business_id ORDER BY item_name) - 1
          AS INTEGER) AS item_encoded FROM (SELECT DISTINCT business_id, item_name FROM daily)),
avgd AS (SELECT business_id, item_name, AVG(quantity) AS a FROM daily GROUP BY ALL),
best AS (SELECT business_id, arg_max(c.item_encoded, (a.a, a.item_name)) AS best_code
         FROM avgd a JOIN codes c USING (business_id, item_name) GROUP BY business_id)
SELECT n.business_id, n.name,
  CAST(COALESCE(c.item_encoded, sc.item_encoded, b.best_code, -1) AS INTEGER) AS item_encoded
FROM names n
LEFT JOIN codes c ON n.business_id = c.business_id AND n.name = c.item_name
LEFT JOIN sim s ON n.business_id = s.business_id AND n.name = s.name
LEFT JOIN codes sc ON s.business_id = sc.business_id AND s.similar_item = sc.item_name
LEFT JOIN best b ON n.business_id = b.business_id""")
def item_code_lookup(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    daily = T.daily_series(spark, sf_dir)
    names = cut_lineage(_lookup_names(sales))   # read by the direct and the similarity lookup
    return I.item_code_lookup(names, FE.item_codes(daily), I.item_category(sales),
                              S.avg_daily_quantity(daily))


@query("J23_fallback_quantity", _BASE.rstrip() + _CAT_SQL + _NAMES_SQL + """,
avgd AS (SELECT business_id, item_name, AVG(quantity) AS a FROM daily GROUP BY ALL),
cavg AS (SELECT d.business_id, COALESCE(c.category, 'Other') AS category, AVG(d.quantity) AS ca
         FROM daily d LEFT JOIN cat c USING (business_id, item_name) GROUP BY ALL),
gavg AS (SELECT business_id, AVG(quantity) AS ga FROM daily GROUP BY business_id)
SELECT n.business_id, n.name, ROUND(COALESCE(a.a, ca.ca, g.ga, 0.0), 6) AS fallback_qty
FROM names n
LEFT JOIN avgd a ON n.business_id = a.business_id AND n.name = a.item_name
LEFT JOIN sim s ON n.business_id = s.business_id AND n.name = s.name
LEFT JOIN cavg ca ON s.business_id = ca.business_id AND s.similar_category = ca.category
LEFT JOIN gavg g ON n.business_id = g.business_id""")
def fallback_quantity(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    daily = T.daily_series(spark, sf_dir)
    cats = I.item_category(sales)
    return round_doubles(I.fallback_quantity(
        _lookup_names(sales), S.avg_daily_quantity(daily), cats,
        I.category_average(daily, cats), S.business_mean(daily)))


# ------------------------------------------------------------ forecast grid and size expansion

_GRID_SQL = """,
bl AS (SELECT business_id, MAX(date) AS last_date FROM daily GROUP BY business_id),
itm AS (SELECT DISTINCT d.business_id, d.item_name, bl.last_date FROM daily d JOIN bl USING (business_id)),
avgd AS (SELECT business_id, item_name, AVG(quantity) AS avg_daily_qty FROM daily GROUP BY ALL),
grid AS (
  SELECT i.business_id, CAST(unnest(generate_series(i.last_date + 1, i.last_date + 8, INTERVAL 1 DAY)) AS DATE)
         AS prediction_date, i.item_name
  FROM itm i
),
fc AS (
  SELECT g.business_id, g.prediction_date, g.item_name,
         GREATEST(CAST(round_even(a.avg_daily_qty, 0) AS INTEGER), 0) AS predicted_quantity
  FROM grid g JOIN avgd a USING (business_id, item_name)
)"""


@query("J13_forecast_grid", _BASE.rstrip() + _GRID_SQL + """
SELECT business_id, prediction_date, item_name FROM grid""")
def forecast_grid(spark, sf_dir):
    daily = S.daily_item_sales(T.sales(spark, sf_dir))
    return FC.forecast_grid(daily, days=7)


_META_SQL = """,
ps AS (SELECT business_id, item_name, size, COALESCE(SUM(quantity), 0) AS q,
              SUM(CAST(round(unit_price * 100) AS BIGINT)) AS pc, COUNT(unit_price) AS pn
       FROM sales WHERE item_name IS NOT NULL GROUP BY ALL),
tot AS (SELECT *, SUM(q) OVER (PARTITION BY business_id, item_name) AS total FROM ps),
dist AS (SELECT business_id, item_name, size, q / total AS share, pc, pn FROM tot
         WHERE size IS NOT NULL AND total > 0),
nsz AS (SELECT business_id, item_name, COUNT(*) AS n FROM dist GROUP BY ALL),
pst AS (SELECT business_id, item_name, SUM(CAST(round(unit_price * 100) AS BIGINT)) AS ic, COUNT(unit_price) AS inn
        FROM sales WHERE item_name IS NOT NULL GROUP BY ALL),
psz AS (SELECT business_id, item_name, size AS primary_size FROM (
  SELECT business_id, item_name, size,
         row_number() OVER (PARTITION BY business_id, item_name ORDER BY COUNT(*) DESC, size) AS rn
  FROM sales WHERE size IS NOT NULL AND item_name IS NOT NULL GROUP BY business_id, item_name, size) WHERE rn = 1)"""


@query("P01_P04_F26_expand_by_size", _BASE.rstrip() + _CAT_SQL + _GRID_SQL + _META_SQL + """,
many AS (
  SELECT f.business_id, f.prediction_date, f.item_name,
         GREATEST(1, CAST(round_even(f.predicted_quantity * d.share, 0) AS INTEGER)) AS qty, d.size,
         CASE WHEN d.pn > 0 THEN d.pc ELSE p.ic END AS c, CASE WHEN d.pn > 0 THEN d.pn ELSE p.inn END AS n,
         c.category, round_even(d.share * 100, 1) AS size_proportion
  FROM fc f JOIN nsz z USING (business_id, item_name) JOIN dist d USING (business_id, item_name)
  LEFT JOIN pst p USING (business_id, item_name) LEFT JOIN cat c USING (business_id, item_name)
  WHERE z.n > 1
)
SELECT business_id, prediction_date, item_name, qty AS predicted_quantity, size,
       CASE WHEN c <> 0 THEN round_even(c / n, 0) / 100 END AS unit_price,
       CASE WHEN c <> 0 THEN round_even(qty * c / n, 0) / 100 END AS predicted_revenue,
       category, size_proportion
FROM many
UNION ALL
SELECT f.business_id, f.prediction_date, f.item_name, f.predicted_quantity, z.primary_size,
       CASE WHEN p.inn > 0 THEN round_even(p.ic / p.inn, 0) / 100 END,
       CASE WHEN p.inn > 0 THEN round_even(f.predicted_quantity * p.ic / p.inn, 0) / 100 END,
       c.category, NULL
FROM fc f LEFT JOIN nsz n USING (business_id, item_name) LEFT JOIN pst p USING (business_id, item_name)
LEFT JOIN cat c USING (business_id, item_name) LEFT JOIN psz z USING (business_id, item_name)
WHERE COALESCE(n.n, 0) <= 1""")
def expand_by_size(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    fc = FC.naive_forecast(T.daily_series(spark, sf_dir), days=7)
    stats = cut_lineage(I.item_size_stats(sales))   # one (item, size) aggregate, read by both profiles
    out = I.expand_by_size(fc, I.item_profile(sales, stats), I.size_profile(sales, stats=stats))
    return round_doubles(out.select("business_id", "prediction_date", "item_name", "predicted_quantity", "size",
                                    "unit_price", "predicted_revenue", "category", "size_proportion"))
