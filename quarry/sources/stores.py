"""Settings of object stores: an S3 store for all buckets or one, with keys, an endpoint, or a role to assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Classes that the S3A connector takes its credentials from.
_SIMPLE = "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
_ASSUMED = "org.apache.hadoop.fs.s3a.auth.AssumedRoleCredentialProvider"
_DEFAULT = "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"


def s3_settings(
    bucket: str | None = None, *, access_key: str | None = None, secret_key: str | None = None, endpoint: str | None = None, region: str | None = None,
    role_arn: str | None = None, session_name: str = "quarry", external_id: str | None = None, duration: str = "1h", path_style: bool = False,
) -> dict[str, str]:
    """Hadoop settings of the store. With role_arn the role is assumed, by the keys given or else by the machine's own identity."""
    if (access_key is None) != (secret_key is None):
        raise ValueError("give both keys or none")
    own = {"endpoint": endpoint, "endpoint.region": region, "path.style.access": "true" if path_style else None, "access.key": access_key, "secret.key": secret_key}
    base = _SIMPLE if access_key else _DEFAULT
    if role_arn:
        own |= {"aws.credentials.provider": _ASSUMED, "assumed.role.arn": role_arn, "assumed.role.session.name": session_name, "assumed.role.session.duration": duration, "assumed.role.credentials.provider": base, "assumed.role.external.id": external_id}
    else:
        own["aws.credentials.provider"] = base
    prefix = f"fs.s3a.bucket.{bucket}." if bucket else "fs.s3a."
    return {prefix + k: v for k, v in own.items() if v is not None}


def configure_s3(spark: SparkSession, **how) -> None:
    """Set the store's settings for this application's file systems."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in s3_settings(**how).items():
        conf.set(k, v)


def table_url(url: str) -> str:
    """s3:// and s3n:// URLs as the connector's own scheme."""
    for scheme in ("s3://", "s3n://"):
        if url.startswith(scheme):
            return "s3a://" + url[len(scheme) :]
    return url
