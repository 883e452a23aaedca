"""The engine's functions under SQL names.

``register(spark)`` makes available: template(text), template_id(text),
norm_level(text), log_time(text) and the table function parse_line(text).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType

from tributary.functions.template import template_id, template_of
from tributary.model import normal_level

PARSED = "format string, ts timestamp_ntz, level string, message string, parsed boolean, fields string"


def _mapped(function, kind):
    """A text function as a pandas UDF that sees each distinct value of a batch once."""

    def run(text: pd.Series) -> pd.Series:
        known = {t: function(t) for t in text.dropna().unique()}
        return text.map(known).astype(object).where(text.notna(), None)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def _time(text: str) -> datetime | None:
    from tributary.dsl.timeexpr import moment
    from tributary.sources.times import parse_time

    stamp = parse_time(text)
    return moment(stamp.us) if stamp else None


class ParseLine:
    """One row for a line of any format."""

    def eval(self, line: str) -> Iterator[tuple]:
        from tributary.dsl.timeexpr import moment
        from tributary.sources.formats import MIXED
        from tributary.sources.reader import canonical

        if line is None:
            return
        record = MIXED.parse(line)
        fields = json.dumps(canonical(record.fields), ensure_ascii=False, separators=(",", ":"), sort_keys=True) if record.fields else None
        yield record.format, moment(record.stamp.us) if record.stamp else None, record.level, record.message, not record.partial, fields


def register(spark: SparkSession) -> None:
    spark.udf.register("template", _mapped(template_of, StringType()))
    spark.udf.register("template_id", _mapped(lambda t: template_id(template_of(t)), StringType()))
    spark.udf.register("norm_level", _mapped(normal_level, StringType()))
    spark.udf.register("log_time", _mapped(_time, TimestampNTZType()))
    spark.udtf.register("parse_line", F.udtf(ParseLine, returnType=PARSED))
