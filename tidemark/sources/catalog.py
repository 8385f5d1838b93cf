"""The database catalogue (``public_data`` map of a YAML settings file).

One catalogue is configuration -- tens of entries -- so :func:`load_catalog` reads
it on the driver and turns it into a small DataFrame (its size is bounded by the
file and checked before any broadcast).  The settings documents of many sites are
a table of texts, which :func:`parse_catalogs` reads where they are.  Defaults follow the settings format:
``validate.max_retries`` 2, ``validate.retry_delay_seconds`` 10; ``db_type``
is accepted as an alias of ``database_type``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fail_if
from ..schemas import CATALOG_SCHEMA
from .rejects import check_mode, reject_rows

# Documents are parsed in Spark's Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_MAX_RETRIES = 2
DEFAULT_RETRY_DELAY = 10


class CatalogError(ValueError):
    pass


def catalog_entries(doc: dict) -> list[tuple]:
    """Rows of the catalogue from a parsed settings document."""
    rows = []
    for name, e in sorted((doc or {}).get("public_data", {}).items()):
        if "s3_url" not in e:
            raise CatalogError(f"{name}: s3_url is required")
        dtype = e.get("database_type", e.get("db_type"))
        if dtype not in ("folder", "file"):
            raise CatalogError(f"{name}: database_type must be folder or file, got {dtype!r}")
        v = e.get("validate")
        val = None
        if v is not None:
            for k in ("enabled", "tool", "dbtype"):
                if k not in v:
                    raise CatalogError(f"{name}: validate.{k} is required")
            val = (bool(v["enabled"]), str(v["tool"]), str(v["dbtype"]),
                   int(v.get("max_retries", DEFAULT_MAX_RETRIES)),
                   int(v.get("retry_delay_seconds", DEFAULT_RETRY_DELAY)))
        rows.append((name, str(e["s3_url"]), e.get("description"), dtype, e.get("exclude"), e.get("include"), val))
    return rows


def load_catalog(spark: SparkSession, yaml_text_or_path: str) -> DataFrame:
    """Parse a settings YAML (text or path) into the catalogue DataFrame."""
    import os

    import yaml
    text = yaml_text_or_path
    if "\n" not in text and os.path.exists(text):
        with open(text, encoding="utf-8") as f:
            text = f.read()
    return spark.createDataFrame(catalog_entries(yaml.safe_load(text)), CATALOG_SCHEMA)


def parse_catalogs(docs: DataFrame, doc: str = "doc", yaml_col: str = "yaml", mode: str = "quarantine") -> DataFrame:
    """S8 over a table of settings documents, one per row: (doc, the entry's columns, reason).

    A document that cannot be used (no YAML, an entry without url, of an unknown type or
    with half a ``validate``) has one row with a ``reason`` and no entry, as the tool takes none of
    it; ``mode='fail'`` fails on it.  A document without ``public_data`` has no row."""
    fields = [f.name for f in CATALOG_SCHEMA.fields]
    free = [T.StructField(f.name, f.dataType) for f in CATALOG_SCHEMA.fields]
    schema = T.StructType([T.StructField("doc", T.StringType()), *free, T.StructField("reason", T.StringType())])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml
        for frame in frames:
            rows = []
            for name, content in zip(frame["doc"], frame["yaml"]):
                try:
                    loaded = yaml.safe_load(content or "")
                    if loaded is not None and not isinstance(loaded, dict):
                        raise CatalogError("no map of settings")
                    rows += [(name, *entry[:-1], entry[-1] and dict(zip(("enabled", "tool", "dbtype", "max_retries", "retry_delay_seconds"), entry[-1])), None)
                             for entry in catalog_entries(loaded)]
                except CatalogError as e:
                    rows.append((name, *[None] * len(fields), str(e)))
                except (yaml.YAMLError, AttributeError, TypeError, ValueError):
                    rows.append((name, *[None] * len(fields), "bad yaml"))
            yield pd.DataFrame(rows, columns=["doc", *fields, "reason"], dtype=object)

    found = docs.select(F.col(doc).cast("string").alias("doc"), F.col(yaml_col).alias("yaml")).mapInPandas(parse, schema)
    return fail_if(found, F.col("reason").isNotNull(), F.col("reason")) if check_mode(mode) == "fail" else found


def catalog_rejects(docs: DataFrame, doc: str = "doc", yaml_col: str = "yaml") -> DataFrame:
    """The documents that cannot be used, as (source, line_no, line, reason)."""
    bad = parse_catalogs(docs, doc, yaml_col).where("reason is not null").select(F.col("doc").alias("_doc"), "reason")
    return reject_rows(docs.join(bad, F.col(doc).cast("string") == F.col("_doc")), F.col("reason"), F.col("_doc"), F.col(yaml_col))
