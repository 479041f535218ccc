"""Dataset and artifact references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concord.functions import messages as M

_ARTIFACT = r"^artifact://([^/]+)/(.+)$"
_URI = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def parse_artifact(reference: Column) -> Column:
    """struct(name, version, error). The version is everything after the first slash of the reference; a NULL
    reference is an error."""
    part = lambda i: F.nullif(F.regexp_extract(reference, _ARTIFACT, i), F.lit(""))
    logical = F.coalesce(reference.startswith("artifact://"), F.lit(False))
    error = F.when(~logical, M.say(M.NOT_AN_ARTIFACT, reference=reference)).when(
        part(1).isNull(), M.say(M.MALFORMED_ARTIFACT, reference=reference)
    )
    return F.struct(part(1).alias("name"), part(2).alias("version"), error.alias("error"))


def split_uri(uri: Column) -> Column:
    """struct(scheme, bucket, path); NULL parts where the text has no ``scheme://``."""
    part = lambda i: F.when(uri.rlike(_URI), F.regexp_extract(uri, _URI, i))
    return F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("path"))


def uri_error(
    protocol: Column,
    uri: Column,
    container: Column | None = None,
    account: Column | None = None,
    mount_path: Column | None = None,
) -> Column:
    """NULL if ``uri`` is addressable by the storage protocol, else the reason.

    s3 and vast-s3 need s3a:// or s3://; adls needs its container and account; vast-nfs its mount path. A NULL uri or
    protocol is addressable by nothing.
    """
    none = F.lit(None).cast("string")
    container, account = container if container is not None else none, account if account is not None else none
    mount = mount_path if mount_path is not None else none
    prefix = F.concat(F.lit("abfss://"), container, F.lit("@"), account, F.lit(".dfs.core.windows.net/"))
    shown = F.coalesce(uri, F.lit("NULL"))
    on_s3 = F.coalesce(uri.startswith("s3a://") | uri.startswith("s3://"), F.lit(False))
    object_store = F.when(~on_s3, F.concat(F.lit("not an S3 URI: "), shown))
    inside = lambda root: F.when(
        ~F.coalesce(uri.startswith(root), F.lit(False)),
        F.concat(F.lit("outside "), F.coalesce(root, F.lit("the configured root")), F.lit(": "), shown),
    )
    return (
        F.when(protocol.isin("s3", "vast-s3"), object_store)
        .when(protocol == "adls", inside(prefix))
        .when(protocol == "vast-nfs", inside(mount))
        .otherwise(F.concat(F.lit("unsupported storage protocol: "), F.coalesce(protocol, F.lit("NULL"))))
    )


def comparable_uri_error(uri: Column) -> Column:
    """The comparison reads object storage: only s3a and s3 locations."""
    scheme = split_uri(uri)["scheme"]
    return F.when(
        ~F.coalesce(scheme.isin("s3a", "s3"), F.lit(False)), F.concat(F.lit("unsupported URI scheme: "), F.coalesce(uri, F.lit("NULL")))
    )


def storage_protocol(provider: Column, config_json: Column) -> Column:
    """vast splits into vast-nfs and vast-s3 by its configured protocol; other providers are their own label."""
    nfs = F.get_json_object(config_json, "$.protocol") == "nfs"
    return F.when(provider == "vast", F.when(nfs, "vast-nfs").otherwise("vast-s3")).otherwise(provider)


def dataset_key(dataset: Column, kind: Column) -> Column:
    """Configuration key under which a job finds the dataset."""
    suffix = F.when(kind == "table", ".identifier").otherwise(".uri")
    return F.concat(F.lit("spark.portable.dataset."), dataset, suffix)
