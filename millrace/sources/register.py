"""Registration of the Python data sources."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import millrace
from millrace.sources.kvtext import KeyValueText
from millrace.sources.models import ImageSet, ModelFile


def register_sources(spark: SparkSession) -> None:
    """``kvtext``, ``tensormodel`` and ``imageset`` for this session.

    The classes travel by value, as the processes that plan and run data sources know no files that the session has added later.
    """
    cloudpickle.register_pickle_by_value(millrace)
    try:
        for source in (KeyValueText, ModelFile, ImageSet):
            spark.dataSource.register(source)
    finally:
        cloudpickle.unregister_pickle_by_value(millrace)
