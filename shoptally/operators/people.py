"""Customer and staff lookups and the checks on a new customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.rules import customer_problem


def find_customers(customer: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """The first ``n`` customers whose id starts with ``prefix``."""
    return customer.where(F.col("id").startswith(prefix)).orderBy("id").limit(n)



def screened(entries: DataFrame, customer: DataFrame) -> DataFrame:
    """New customer entries in stored form (title-case name, lower-case e-mail) with ``problem``:
    the first rule broken, NULL for an entry that can be created."""
    tidy = entries.withColumn("email", F.lower(F.trim("email"))).withColumn(
        "name", F.initcap(F.trim("name")))
    ids = customer.select("id").distinct().withColumn("_id", F.lit(True))
    mails = customer.where(F.col("email").isNotNull()).select("email").distinct().withColumn(
        "_mail", F.lit(True))
    form = customer_problem(F.col("id"), F.col("name"), F.col("email"))
    problem = (
        F.when(form == "phone", form).when(F.col("_id"), "known id").when(form == "name", form)
        .when((F.col("email") != "") & F.col("_mail"), "known email").otherwise(form)
    )
    return (
        tidy.join(ids, "id", "left").join(mails, "email", "left")
        .withColumn("problem", problem).select("id", "name", "email", "problem")
    )


def names(df: DataFrame) -> DataFrame:
    """id to name, one row per person."""
    return df.select("id", "name")
