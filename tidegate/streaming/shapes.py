"""Renames by drift shape, kept as a table over batches.

A shape is what renames depend on: contract, missing and unexpected fields with their types. Names are
compared (in Python) only for shapes that the table does not have; their renames are then added to it. A
batch of known shapes runs no Python. The table has a folder for each set of hints and type rules, so results of
other settings are not met. A replayed batch may add a shape twice, with the same result; one is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions.names import RenameHints
from tidegate.functions.sqltypes import TypeMatrix
from tidegate.plans.staging import staged


class ShapeDictionary:
    """Renames of all shapes met so far, below ``root``."""

    def __init__(self, root: str, matrix: TypeMatrix | None = None, hints: RenameHints | None = None):
        self.matrix, self.hints = matrix or TypeMatrix(), hints or RenameHints()
        rules = [sorted(map(str, vars(self.matrix).items())), self.hints.synonym_pairs(), sorted(self.hints.decorators),
                 [fixed.WEIGHT_LEXICAL, fixed.WEIGHT_TYPE, fixed.WEIGHT_NULL, fixed.RENAME_MIN]]
        self.path = f"{root}/rules={hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]}"

    def known(self, spark: SparkSession) -> DataFrame | None:
        """``shape`` and ``possible_renames``; None while there is none."""
        try:
            return spark.read.parquet(self.path)
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise

    def meet(self, rows: DataFrame, shape: str, describe: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Adds ``possible_renames``, null where ``shape`` is null. Rows are read several times: hand in stored or persisted ones.

        ``score`` gives (``shape``, ``possible_renames``) for distinct shapes with the columns ``describe``.
        """
        spark = rows.sparkSession
        shaped = rows.where(F.col(shape).isNotNull())
        met = staged(shaped.groupBy(shape).agg(*(F.first(c).alias(c) for c in describe)), "met-shapes")
        known = self.known(spark)
        unseen = met if known is None else met.join(known, shape, "left_anti")
        if not unseen.isEmpty():
            score(unseen).write.mode("append").parquet(self.path)
            known = self.known(spark)
        if known is None:
            return rows.withColumn("possible_renames", F.lit(None).cast(score(unseen).schema["possible_renames"].dataType))
        # a stored table, so that Spark knows its size: small ones are broadcast and rows are not moved
        renames = staged(known.join(met.select(shape), shape, "left_semi").dropDuplicates([shape]), "renames-of-shapes")
        without = rows.where(F.col(shape).isNull()).withColumn("possible_renames", F.lit(None).cast(renames.schema["possible_renames"].dataType))
        return shaped.join(renames, shape, "left").select(*rows.columns, "possible_renames").unionByName(without)
