"""Object locators from run XML documents.

The archive's run XML is scanned tag by tag in document order.  A ``SRAFile``
or ``Run`` tag resets the current md5/size to its own attributes (a missing
md5 is null, a missing or bad size is 0); the first ``Alternatives`` tag with
org=AWS, free_egress=worldwide and a url that resolves to an s3/https pair
wins and takes the current md5/size.  Tag and attribute names and the two
attribute values are compared case-insensitively.

Each document is one row; the tags are tokenised into an array and the
document order is handled with higher-order array functions, so there is no
shuffle and no Python.  ``from_xml`` / the XML source are not used because a
schema-based parse groups elements by name and loses their interleaving:
which ``SRAFile``/``Run`` tag last preceded the winning ``Alternatives`` is a
document-order question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import _c, _u64_or_null, resolve_url_pair
from .rejects import check_mode, checked, reject_rows

# Start or empty-element tags; quoted attribute values may contain '>'.  Possessive, so that
# a tag of any length is matched without a stack that grows with it.
_TAG = r"""<[A-Za-z_](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_NAME = r"""^<(?:[^\s/>:]+:)?([^\s/>]+)"""


def _attr_re(name: str) -> str:
    return r"""(?i)\s""" + name + r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')"""


def _attr(tag: Column, name: str) -> Column:
    """Attribute value (raw, not unescaped) or null when absent."""
    rx = _attr_re(name)
    v = F.when(tag.rlike(rx), F.concat(F.regexp_extract(tag, rx, 1), F.regexp_extract(tag, rx, 2)))
    return v


def _xml_reason(xml: Column) -> Column:
    whole = F.from_xml(xml, "_bad string, _any string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(F.trim(F.coalesce(xml, F.lit(""))) == "", F.lit("no document")).when(whole["_bad"].isNotNull(), F.lit("bad xml"))


def locator_rejects(df: DataFrame, xml: str = "xml", run: str = "run_id") -> DataFrame:
    """Documents that are no well-formed XML, as (source, line_no, line, reason)."""
    return reject_rows(df, _xml_reason(F.col(xml)), F.col(run), F.col(xml))


def extract_locators(df: DataFrame, xml: str = "xml", mode: str = "quarantine") -> DataFrame:
    """Adds s3_uri, http_url, md5, size (all null when no locator qualifies).  A
    document that is no well-formed XML is read as far as its tags go
    (:func:`locator_rejects` has it); ``mode='fail'`` fails on it."""
    if check_mode(mode) == "fail":
        df = checked(df, _xml_reason(F.col(xml)), mode)
    # One pass over the tags: the md5 and size in force, and what the first locator takes.  Each
    # tag is looked at once, and a locator already found only passes through.
    state = "struct<s3_uri:string,http_url:string,md5:string,size:string,found:boolean>"
    nothing = F.from_json(F.lit('{"found":false}'), state)

    def seen(acc: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, _NAME, 1))
        reset = F.struct(acc["s3_uri"].alias("s3_uri"), acc["http_url"].alias("http_url"), _attr(tag, "md5").alias("md5"),
                         _attr(tag, "size").alias("size"), F.lit(False).alias("found"))
        open_ = (F.lower(_attr(tag, "org")) == "aws") & (F.lower(_attr(tag, "free_egress")) == "worldwide")
        pair = F.when(open_, resolve_url_pair(F.nullif(_attr(tag, "url"), F.lit(""))))
        taken = F.struct(pair["s3_uri"].alias("s3_uri"), pair["http_url"].alias("http_url"), acc["md5"].alias("md5"),
                         acc["size"].alias("size"), pair.isNotNull().alias("found"))
        return F.when(acc["found"], acc).when(name.isin("srafile", "run"), reset).when(name == "alternatives", taken).otherwise(acc)

    tags = F.regexp_extract_all(_c(xml), F.lit(_TAG), 0)
    # generated, so that no filter on the result is moved below it and evaluates the pass again
    staged = df.select("*", F.inline(F.array(F.aggregate(tags, nothing, seen).alias("_loc"))).alias("s3_uri", "http_url", "_md5", "_size", "_found"))
    found = F.col("_found")
    size = F.coalesce(_u64_or_null(F.col("_size")), F.lit(0).cast("decimal(20,0)"))
    return (staged
            .withColumn("md5", F.when(found, F.col("_md5")))
            .withColumn("size", F.when(found, size))
            .drop("_md5", "_size", "_found"))
