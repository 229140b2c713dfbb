"""Session settings the jobs rely on.

Only runtime SQL settings are touched, so the same call works on a session
somebody else created (a cluster, a notebook, a test).
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Months, weeks and hours of the day are taken in one fixed zone.
    "spark.sql.session.timeZone": "UTC",
    # Partition sizes and skewed join keys are decided from real sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Lets a left join to a keyed roll-up vanish when no column of it is used.
    "spark.sql.optimizer.propagateDistinctKeys.enabled": "true",
}

#: MB of shuffled, compressed rows that adaptive execution puts together for one task, unless the session has less.  Joins and
#: roll-ups by order hold them unpacked in several sorts and hash tables at once, 20 times as much.
TASK_MB = 16
TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes(size: str) -> int:
    """The bytes of a size as Spark writes it: ``64MB``, ``8m``, ``1g``, ``512``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if _bytes(spark.conf.get(TASK_SIZE)) > TASK_MB << 20:
        spark.conf.set(TASK_SIZE, f"{TASK_MB}m")
    return spark
