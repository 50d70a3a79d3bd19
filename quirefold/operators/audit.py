"""Hosts named in texts, against allowlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Asset hosts that are never allowed.
ASSET_HOSTS = ("cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "esm.sh", "fonts.googleapis.com", "fonts.gstatic.com", "raw.githubusercontent.com")


def hosts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, host) for each address in a text; hosts without a dot cannot be external and are left out."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?i)https?://([a-z0-9.-]+)"), 1)).alias("h"))
    return found.select(key, F.regexp_replace(F.lower("h"), r"\.\z", "").alias("host")).where(F.col("host").contains("."))


def violations(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """(host, reason, n): the hosts outside the allowlist; asset hosts are named as such even if they are allowed."""
    asset = F.col("host").isin(*ASSET_HOSTS)
    named = found.join(allowed.select("host", F.lit(True).alias("fine")).distinct(), "host", "left")
    return named.where(F.col("fine").isNull() | asset).groupBy("host").agg(F.count("*").alias("n")).withColumn("reason", F.when(asset, F.lit("asset")).otherwise(F.lit("unknown")))
