"""Statistics kept by deltas: a table of counts that a day's signed changes are added to, so that no article is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brevier.operators import rules as R
from brevier.operators.stats import CELLS, added_up, cells, changed_cells
from brevier.sources.corpus import read_table, update_table


def add_changes(spark: SparkSession, path: str, removed: DataFrame, added: DataFrame, pack: R.RulePack, batch: tuple[str, int] | None = None) -> int | None:
    """Count articles out and in: removed ones and changed ones as they were, added ones and changed ones as they are.

    One commit of the counts, see `update_table`: a batch that comes again, or a job that dies, changes nothing. The cost
    is that of the day's articles and of the cells, whose number grows with the days and sources and not with the articles.
    """
    delta = changed_cells(cells(removed, pack), cells(added, pack))
    return update_table(spark, path, lambda kept: added_up(kept.unionByName(delta)), batch, schema=CELLS)


def kept_cells(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CELLS)
