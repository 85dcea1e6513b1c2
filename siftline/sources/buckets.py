"""Buckets by alias, and the options by which Spark reaches them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Bucket:
    """A bucket's alias, its name at an S3-like endpoint, and the access key; the secret stays in the environment."""

    alias: str
    bucket: str
    endpoint: str
    access_key: str
    region: str = ""

    @property
    def secret_variable(self) -> str:
        return re.sub("[^A-Z0-9]", "_", self.alias.upper())


def resolve(target: str, buckets: list[Bucket]) -> tuple[Bucket, str]:
    """The bucket and prefix of "alias[:prefix]"; an unknown alias or a prefix that leaves its bucket is an error."""
    alias, _, prefix = target.partition(":")
    found = next((b for b in buckets if b.alias == alias), None)
    if found is None:
        raise LookupError(f"no bucket is called {alias!r}")
    prefix = prefix.strip("/")
    if ".." in prefix.split("/"):
        raise ValueError(f"prefix leaves its bucket: {prefix}")
    return found, f"{prefix}/" if prefix else ""


def uri(target: str, buckets: list[Bucket]) -> str:
    bucket, prefix = resolve(target, buckets)
    return f"s3a://{bucket.bucket}/{prefix}"


def s3a_options(buckets: list[Bucket], environment: dict[str, str] | None = None) -> dict[str, str]:
    """Spark settings for all buckets; two entries for one bucket at different endpoints are an error."""
    env = os.environ if environment is None else environment
    options: dict[str, str] = {}
    seen: dict[str, Bucket] = {}
    for b in buckets:
        if seen.setdefault(b.bucket, b).endpoint != b.endpoint:
            raise ValueError(f"bucket {b.bucket} stands for two places: {seen[b.bucket].alias} and {b.alias}")
        head = f"spark.hadoop.fs.s3a.bucket.{b.bucket}"
        options |= {f"{head}.endpoint": b.endpoint, f"{head}.access.key": b.access_key, f"{head}.secret.key": env.get(b.secret_variable, ""), f"{head}.path.style.access": "true"}
        if b.region:
            options[f"{head}.endpoint.region"] = b.region
    return options
