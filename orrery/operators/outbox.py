"""Delivery of accepted decisions to the host: pending work, receipts, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows of ``outbox`` (materialization_id, decision_id) without a receipt of the same decision."""
    return outbox.join(receipts.select("materialization_id", "decision_id").dropDuplicates(), ["materialization_id", "decision_id"], "left_anti")


def receipt_errors(receipts: DataFrame, outbox: DataFrame) -> DataFrame:
    """(materialization_id, error): a receipt needs a pending row of the same decision."""
    known = outbox.select("materialization_id", F.col("decision_id").alias("_of"))
    code = F.when(F.col("_of").isNull(), "MissingMaterialization").when(F.col("_of") != F.col("decision_id"), "DecisionMismatch")
    return receipts.join(known, "materialization_id", "left").select("materialization_id", code.alias("error")).where("error IS NOT NULL")


def retry(outbox: DataFrame, receipts: DataFrame, deliver) -> DataFrame:
    """New receipts: ``deliver`` maps the pending rows to the (materialization_id, decision_id) that went through.

    What has a receipt already is not delivered again.
    """
    return deliver(pending(outbox, receipts)).select("materialization_id", "decision_id")
