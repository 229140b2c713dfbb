"""The population dimension used to put states of different size on one scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources.inline import inline_table

# Inhabitants of the 27 Brazilian federal units.
BRAZIL_POPULATION = {
    "SP": 46649132, "MG": 21411923, "RJ": 17463349, "BA": 14985284,
    "PR": 11597484, "RS": 11466630, "PE": 9674793, "CE": 9240580,
    "PA": 8777124, "SC": 7338473, "MA": 7153262, "GO": 7206589,
    "PB": 4059905, "AM": 4269995, "ES": 4108508, "RN": 3560903,
    "AL": 3365351, "PI": 3289290, "MT": 3567234, "DF": 3094325,
    "MS": 2839188, "SE": 2338474, "RO": 1815278, "TO": 1607363,
    "AC": 906876, "AP": 877613, "RR": 652713,
}


def population(spark: SparkSession, by_state: dict[str, int] | None = None) -> DataFrame:
    """``state, population``; the 27 Brazilian states unless others are given."""
    columns = {"state": "string", "population": "bigint"}
    return inline_table(spark, columns, (by_state or BRAZIL_POPULATION).items())


def with_population(df: DataFrame, pop: DataFrame, state: str) -> DataFrame:
    """Add ``population`` by state; unknown states get null.

    Small dimensions are broadcast by Spark's own size check.
    """
    return df.join(pop.select(F.col("state").alias(state), "population"), state, "left")
