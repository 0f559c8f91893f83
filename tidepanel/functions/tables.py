"""Table functions for SQL users. Plans use the column expressions, which stay in the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class BusinessDays:
    """business_days(start, end): every weekday between two dates."""

    def eval(self, start: dt.date, end: dt.date):
        if start is None or end is None:
            return
        day = start
        while day <= end:
            if day.weekday() < 5:
                yield (day,)
            day += dt.timedelta(days=1)


def register(spark: SparkSession) -> None:
    spark.udtf.register("business_days", udtf(BusinessDays, returnType="day date"))
