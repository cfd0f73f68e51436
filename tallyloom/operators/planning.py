"""Planning applications: outcomes, trends, objections, value and applicant effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, first_rows, ratio
from ..registry import named



def approved() -> Column:
    return F.col("status") == "approved"


def refused() -> Column:
    return F.col("status") == "refused"


DECIDED = "status IN ('approved', 'refused')"


@named("""SELECT count(*) AS total, count(CASE WHEN status = 'approved' THEN 1 END) AS approved, count(CASE WHEN status = 'refused' THEN 1 END) AS refused, count(CASE WHEN status = 'deferred' THEN 1 END) AS deferred,
    count(CASE WHEN status = 'approved' THEN 1 END) / nullif(count(CASE WHEN status IN ('approved', 'refused') THEN 1 END), 0) AS approval_rate FROM applications""")
def planning_outcomes(t) -> DataFrame:
    return t.applications.agg(F.count(F.lit(1)).alias("total"), count_if(approved()).alias("approved"), count_if(refused()).alias("refused"), count_if(F.col("status") == "deferred").alias("deferred"), ratio(count_if(approved()), count_if(approved() | refused())).alias("approval_rate"))


@named("SELECT site_id, count(*) AS n FROM applications GROUP BY 1 ORDER BY n DESC, site_id LIMIT 20")
def top_planning_sites(t) -> DataFrame:
    return t.applications.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "site_id").limit(20)


@named("SELECT applicant_name, count(*) AS n FROM applications GROUP BY 1 ORDER BY n DESC, applicant_name LIMIT 10")
def top_applicants(t) -> DataFrame:
    return t.applications.groupBy("applicant_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "applicant_name").limit(10)


@named("""SELECT year, count(*) AS n_applications, count(CASE WHEN status IN ('approved', 'refused') THEN 1 END) AS decided, count(CASE WHEN status = 'approved' THEN 1 END) AS approved, count(CASE WHEN status = 'refused' THEN 1 END) AS refused,
    count(CASE WHEN status = 'approved' THEN 1 END) / nullif(count(CASE WHEN status IN ('approved', 'refused') THEN 1 END), 0) AS approval_rate FROM applications GROUP BY 1""")
def planning_trend(t) -> DataFrame:
    return t.applications.groupBy("year").agg(F.count(F.lit(1)).alias("n_applications"), count_if(approved() | refused()).alias("decided"), count_if(approved()).alias("approved"), count_if(refused()).alias("refused"), ratio(count_if(approved()), count_if(approved() | refused())).alias("approval_rate"))


@named("""SELECT o.application_id IS NOT NULL AS objected, count(*) AS n, count(CASE WHEN status = 'approved' THEN 1 END) / count(*) AS approval_rate FROM applications a LEFT JOIN (SELECT DISTINCT application_id FROM submissions WHERE lower(position) = 'object') o ON o.application_id = a.id
    WHERE status IN ('approved', 'refused') GROUP BY 1""")
def objection_exists(t) -> DataFrame:
    o = t.submissions.filter(F.lower("position") == "object").select(F.col("application_id").alias("id")).distinct().withColumn("o", F.lit(True))
    a = t.applications.filter(DECIDED).join(o, "id", "left").groupBy(F.coalesce("o", F.lit(False)).alias("objected"))
    return a.agg(F.count(F.lit(1)).alias("n"), count_if(approved()).alias("k")).select("objected", "n", (F.col("k") / F.col("n")).alias("approval_rate"))


_BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END"


@named(f"""WITH c AS (SELECT a.id, status, count(s.application_id) AS n FROM applications a LEFT JOIN submissions s ON s.application_id = a.id AND lower(s.position) = 'object' WHERE status IN ('approved', 'refused') GROUP BY 1, 2)
    SELECT {_BUCKET} AS bucket, count(*) AS n, count(CASE WHEN status = 'refused' THEN 1 END) AS refused, count(CASE WHEN status = 'refused' THEN 1 END) / count(*) AS refusal_rate FROM c GROUP BY 1""")
def objection_dose(t) -> DataFrame:
    """Objections are counted as rows, whatever their stated count."""
    a, s = t.applications.filter(DECIDED), t.submissions
    c = a.join(s, (F.col("application_id") == F.col("id")) & (F.lower("position") == "object"), "left").groupBy("id", "status").agg(F.count("application_id").alias("n"))
    bucket = F.when(F.col("n") == 0, "0").when(F.col("n") == 1, "1").when(F.col("n") <= 4, "2-4").otherwise("5+")
    return c.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), count_if(refused()).alias("refused")).withColumn("refusal_rate", F.col("refused") / F.col("n"))


@named("""SELECT a.id AS application_id, applicant_name, estimated_value AS value, estimated_value IS NOT NULL AS value_recorded, coalesce(k, 0) AS objector_count, status AS outcome FROM applications a
    LEFT JOIN (SELECT application_id, cast(sum(coalesce(nullif(n, 0), 1)) AS bigint) AS k FROM submissions WHERE position = 'object' GROUP BY 1) s ON s.application_id = a.id""")
def application_fact(t) -> DataFrame:
    """Objections are summed by stated count; none or 0 counts 1."""
    k = t.submissions.filter("position = 'object'").groupBy(F.col("application_id").alias("id")).agg(F.sum(F.coalesce(F.nullif("n", F.lit(0)), F.lit(1))).alias("k"))
    return t.applications.join(k, "id", "left").select(F.col("id").alias("application_id"), "applicant_name", F.col("estimated_value").alias("value"), F.col("estimated_value").isNotNull().alias("value_recorded"), F.coalesce("k", F.lit(0)).alias("objector_count"), F.col("status").alias("outcome"))


@named("""WITH r AS (SELECT estimated_value, status, row_number() OVER (ORDER BY estimated_value, id) AS rn, count(*) OVER () AS n FROM applications WHERE status IN ('approved', 'refused'))
    SELECT cast(least(floor((rn - 1) / (floor(n / 4))), 3) + 1 AS int) AS quartile, count(*) AS n, count(CASE WHEN status = 'approved' THEN 1 END) / count(*) AS approval_rate, max(estimated_value) AS top_value FROM r GROUP BY 1""")
def value_quartiles(t) -> DataFrame:
    """Quarters of floor(n / 4) rows in order of value, the remainder in the last.

    Cuts come from a distributed sort: rows are numbered within range
    partitions and offset by the sizes of those before, not in one window.
    """
    a = t.applications.filter(DECIDED).select("id", "status", "estimated_value")
    ranked = a.withColumn("part", F.floor(F.col("estimated_value") / 1000).cast("long"))
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    rn = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("estimated_value", "id"))
    q = ranked.join(before, "part").withColumn("rn", rn)
    quartile = (F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / 4)), F.lit(3)) + 1).cast("int")
    return q.groupBy(quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), (count_if(approved()) / F.count(F.lit(1))).alias("approval_rate"), F.max("estimated_value").alias("top_value"))


_FREQ = "CASE WHEN times = 1 THEN '1' WHEN times <= 3 THEN '2-3' WHEN times <= 6 THEN '4-6' ELSE '7+' END"


@named(f"""SELECT {_FREQ} AS frequency, count(*) AS n, count(CASE WHEN status = 'approved' THEN 1 END) / count(*) AS approval_rate FROM (SELECT *, count(*) OVER (PARTITION BY applicant_name) AS times FROM applications) x WHERE status IN ('approved', 'refused') GROUP BY 1""")
def applicant_frequency(t) -> DataFrame:
    times = t.applications.groupBy("applicant_name").agg(F.count(F.lit(1)).alias("times"))
    bucket = F.when(F.col("times") == 1, "1").when(F.col("times") <= 3, "2-3").when(F.col("times") <= 6, "4-6").otherwise("7+")
    a = t.applications.filter(DECIDED).join(times, "applicant_name").groupBy(bucket.alias("frequency"))
    return a.agg(F.count(F.lit(1)).alias("n"), (count_if(approved()) / F.count(F.lit(1))).alias("approval_rate"))


@named("""SELECT site_id % 40 AS street, count(DISTINCT site_id) AS sites, count(*) AS applications, string_agg(DISTINCT cast(site_id AS string), ',' ORDER BY cast(site_id AS string)) AS site_list FROM applications GROUP BY 1""")
def record_streets(t) -> DataFrame:
    return t.applications.groupBy((F.col("site_id") % 40).alias("street")).agg(F.count_distinct("site_id").alias("sites"), F.count(F.lit(1)).alias("applications"), F.concat_ws(",", F.sort_array(F.collect_set(F.col("site_id").cast("string")))).alias("site_list"))


@named("""SELECT year, count(*) AS total_items, count(amount) AS items_with_amount, round(sum(amount), 2) AS total_amount FROM budget_items GROUP BY 1""")
def budget_by_year(t) -> DataFrame:
    return t.budget_items.groupBy("year").agg(F.count(F.lit(1)).alias("total_items"), F.count("amount").alias("items_with_amount"), F.round(F.sum("amount"), 2).alias("total_amount"))


@named("""WITH r AS (SELECT year, description, amount, row_number() OVER (PARTITION BY year ORDER BY amount DESC, id) AS rn FROM budget_items WHERE amount IS NOT NULL) SELECT * FROM r WHERE rn <= 5""")
def budget_top_n(t) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.desc("amount"), "id")
    return t.budget_items.filter("amount IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("year", "description", "amount", "rn")
