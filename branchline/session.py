"""The Spark session of the command line, and the settings an Iceberg catalog needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .config import Config

#: Catalog types of Spark's Iceberg catalog; the rest speak its REST protocol. Fixed values.
ICEBERG_TYPES = {"glue": "glue", "hive": "hive", "sql": "jdbc", "polaris": "rest", "nessie": "rest", "rest": "rest", "in-memory": "hadoop", "dynamodb": "dynamodb", "bigquery": "bigquery"}
#: The runtime that Iceberg catalogs need, fetched unless ``engines.spark`` names packages of its own; and AWS's clients. Fixed values.
RUNTIME, AWS = "org.apache.iceberg:iceberg-spark-runtime-4.0_2.13:1.10.0", "org.apache.iceberg:iceberg-aws-bundle:1.10.0"
#: Catalog settings for object stores, and what Spark's own readers call them. Fixed values.
S3A = {
    "s3.access-key-id": "access.key",
    "s3.secret-access-key": "secret.key",
    "s3.session-token": "session.token",
    "s3.endpoint": "endpoint",
    "s3.path-style-access": "path.style.access",
    "client.region": "endpoint.region",
}


def store_settings(cfg: Config) -> dict[str, str]:
    """Hadoop's names for the object-store settings of the catalog. Without any, Hadoop's own chain finds credentials:
    environment variables, profiles and the machine's role."""
    given = cfg.warehouse.catalog.model_extra or {}
    return {f"spark.hadoop.fs.s3a.{name}": str(given[key]) for key, name in S3A.items() if key in given}


def iceberg_settings(cfg: Config, name: str = "lake") -> dict[str, str]:
    catalog = cfg.warehouse.catalog
    if catalog.type == "parquet":
        return {}
    prefix = f"spark.sql.catalog.{name}"
    aws = catalog.type in ("glue", "dynamodb") or catalog.warehouse.startswith(("s3:", "s3a:"))
    out = {"spark.jars.packages": ",".join([RUNTIME, *[AWS] * aws]), "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions"}
    if aws:
        out[f"{prefix}.io-impl"] = "org.apache.iceberg.aws.s3.S3FileIO"
    out |= {prefix: "org.apache.iceberg.spark.SparkCatalog", f"{prefix}.type": ICEBERG_TYPES[catalog.type], f"{prefix}.cache-enabled": "false", f"{prefix}.warehouse": catalog.warehouse}
    for key, value in (catalog.model_extra or {}).items():
        if key == "uri" and catalog.type == "sql":
            value = "jdbc:" + value.split("://", 1)[0].split("+")[0] + "://" + value.split("://", 1)[1] if "://" in value else value
        out[f"{prefix}.{key}"] = str(value)
    return out


def session(cfg: Config) -> SparkSession:
    builder = SparkSession.builder.appName("branchline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in {**store_settings(cfg), **iceberg_settings(cfg), **{k: str(v) for k, v in cfg.engines.spark.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
