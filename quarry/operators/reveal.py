"""Personal data of beneficiaries, revealed on request, and the log of who asked for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Columns that are kept encrypted.
SECRET = ("name", "document", "email", "phone")


def encrypted(value: Column | str, key: str) -> Column:
    """A text as AES-GCM bytes; null stays null."""
    return F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(key.encode()), F.lit("GCM"))


def access_rows(requests: DataFrame, allowed: bool) -> DataFrame:
    """The log's rows of requests (request_id, tenant_id, user_id, beneficiary_id, reason): one for each request_id."""
    once = requests.groupBy("request_id").agg(F.min(F.struct("tenant_id", "user_id", "beneficiary_id", "reason")).alias("_r")).select("request_id", "_r.*")
    return once.withColumns({"action": F.lit("reveal_success" if allowed else "reveal_denied"), "allowed": F.lit(allowed)})


def revealed(beneficiaries: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(request_id, id, name, document, email, phone): of each request the beneficiary of its tenant, if there is one that is not deleted. Empty values are null."""
    asked = access_rows(requests, True).select("request_id", "tenant_id", F.col("beneficiary_id").alias("id"))
    plain = [F.nullif(F.decode(F.aes_decrypt(c, F.lit(key.encode()), F.lit("GCM")), "UTF-8"), F.lit("")).alias(c) for c in SECRET]
    return asked.join(beneficiaries.where("deleted_at is null"), ["tenant_id", "id"]).select("request_id", "id", *plain)


def reveal(beneficiaries: DataFrame, requests: DataFrame, key: str | None, log: str) -> DataFrame:
    """As revealed, once every request is in the log (Parquet below `log`), and only then. Without a key the denial is logged and an error raised.

    A request_id is logged once: a call that is made again, after a failure or by a retry, adds nothing. Tasks that are
    retried write nothing twice, since a Parquet write counts only what it commits.
    """
    rows = access_rows(requests, bool(key))
    try:
        known = requests.sparkSession.read.schema(rows.schema).parquet(log).where(F.col("allowed") == bool(key)).select("request_id")
        rows = rows.join(known, "request_id", "left_anti")
    except AnalysisException:
        pass  # the log's first rows
    rows.write.mode("append").parquet(log)
    if not key:
        raise PermissionError("no encryption key is configured")
    return revealed(beneficiaries, requests, key)
