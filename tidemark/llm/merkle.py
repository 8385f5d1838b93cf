"""A Merkle manifest of a dataset, and every row's proof by pointer jumping.

A row's leaf is the SHA-256 of its fields, each written with its length.  Per
source the leaves, in the order of their ids, form a tree of ``FANOUT`` children
per node; the sources' roots form one more tree on top.  H is SHA-256 in
lower-case hex over concatenated parts, digests taken as hex text.

Siblings are kept as *runs*, one row of up to ``FANOUT`` digests.  A node is a
run's digest in the run above; it points to that run and holds the digests left
and right of it there (its segment).  Pointer jumping joins the nodes with
themselves: each appends the segments of the node it points to and points where
that one does, so the distance doubles with every join until all reach the root.
Leaves read their own siblings in their run and take the run's segments from
there on, so a segment is stored once for ``FANOUT`` leaves, and texts and
leaves do not travel in the joins.

Every level and every round of joins is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_no, lookup, numbered, ordered, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the scope of the tree over the sources' roots
# Bytes of segments up to which a round of joins broadcasts the ancestors.
BROADCAST_BYTES = 16 << 20


def field(value: Column) -> Column:
    """``-`` for null, else the value's number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text.cast("binary")).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def _run_id(scope: Column, level: Column, run: Column) -> Column:
    return F.struct(scope.cast("long").alias("scope"), level.cast("int").alias("level"), run.cast("long").alias("run"))


def _levels(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Levels of runs over ``nodes`` (scope, pos, digest, size and what else ``item``
    holds), ``size`` being the number of nodes of the scope and ``most`` the largest.

    A level has scope, level, run, items (the run's nodes in order), digest and size
    (the number of runs of the scope); where that is 1 the digest is the scope's root.
    The only node of a scope is its root itself: a run ``alone``, which is not hashed."""
    out = []
    while not out or most > 1:
        level = len(out)
        extra = [c for c in nodes.columns if c not in ("scope", "size")]
        runs = nodes.groupBy("scope", "size", F.expr(f"pos div {FANOUT}").alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("pos", *[c for c in extra if c != "pos"]))).alias("items"))
        joined = F.concat_ws("", F.transform("items", lambda x: _hex(x["digest"])))
        runs = runs.select("scope", F.lit(level).alias("level"), "run", "items", (F.col("size") == 1).alias("alone"),
                           F.when(F.col("size") > 1, F.unhex(hashed(joined))).otherwise(F.col("items")[0]["digest"]).alias("digest"),
                           F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"))
        out.append(stored(runs, f"{name}-{level}"))
        nodes = out[-1].where("size > 1").select("scope", F.col("run").alias("pos"), "digest", "size", _run_id(F.col("scope"), F.col("level"), F.col("run")).alias("id"))
        most = -(-most // FANOUT)
    return out


def _beside(items: Column, at: Column) -> Column:
    """The digests left and right of place ``at`` (from 0) of a run, concatenated."""
    side = lambda x: F.aggregate(x, F.lit(b"").cast("binary"), lambda a, i: F.concat(a, i["digest"]))
    return F.struct(side(F.slice(items, F.lit(1), at)).alias("left"), side(F.slice(items, at + 2, F.lit(FANOUT))).alias("right"))


def _children(runs: DataFrame) -> DataFrame:
    """The nodes of these runs: id (the run whose digest the node is), up (the run it is part of), path (its segment)."""
    here = _run_id(F.col("scope"), F.col("level"), F.col("run"))
    each = runs.select(here.alias("up"), "items", F.posexplode("items").alias("at", "item"))
    return each.select(F.col("item.id").alias("id"), "up", F.array(_beside(F.col("items"), F.col("at"))).alias("path"))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof as one hex text, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))))


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (hex) and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: hashed(F.concat(_hex(s["left"]), h, _hex(s["right"]))))


def proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
           altered: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """(id, leaf, altered_leaf, subroot, root, proof) for every row of ``docs``.

    ``leaf``, ``subroot`` (of the row's source) and ``root`` are hex; ``proof`` holds a
    struct (left, right) of binary digests per level, leaf first: ``fold(leaf, proof)``
    is the root.  ``altered`` maps the fields to a version of the row to be checked
    against the manifest; ``altered_leaf`` is its leaf.  Null ids come first in their
    source and rows of equal ids follow their leaf; rows equal in all fields get a leaf
    each.  Null sources come first, the others in UTF-8 order.  An empty table has no rows.
    """
    spark = docs.sparkSession
    own = {c: F.col(column_no(docs, c)) for c in {*fields, id_col, source_col}}
    leaf = lambda f: F.unhex(hashed(F.concat(*[field(f[c]) for c in fields])))
    rows = numbered(docs).select(
        F.coalesce(F.concat(F.lit("="), own[source_col].cast("string")), F.lit("")).alias("source"), own[id_col].isNotNull().alias("has_id"),
        own[id_col].alias("id"), leaf(own).alias("digest"), leaf(altered(own) if altered else own).alias("altered"),
        F.monotonically_increasing_id().alias("tie"))
    # Written before it is sorted: ``tie`` is then fixed, and a lost executor does not read the texts again.
    rows = stored(rows, "merkle-leaves")
    rows = ordered(rows, ["source", "has_id", "id", "digest", "tie"], {}, "merkle-order")
    starts = stored(rows.groupBy("source").agg(F.min("pos").alias("scope"), F.count("*").alias("size")), "merkle-sources")
    most, sources = starts.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    leaves = lookup(rows, starts, ["source"]).select("scope", (F.col("pos") - F.col("scope")).alias("pos"), "digest", "size", "id", "altered")

    levels = _levels(leaves, most, "merkle-runs")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    here = _run_id(F.col("scope"), F.col("level"), F.col("run")).alias("id")
    roots = stored(ordered(union([r.where("size = 1").select("scope", "digest", here) for r in levels]), ["scope"], {}, "merkle-roots"), "merkle-roots-placed")
    tops = _levels(roots.select(F.lit(TOP).cast("long").alias("scope"), "pos", "digest", F.lit(sources).cast("long").alias("size"), "id"), sources, "merkle-top")
    top = tops[-1].first()  # the only run of its level, none in an empty table
    root = bytes(top["digest"]).hex() if top else None

    # Nodes with their first segments.  A single source's root has no siblings: its own tree is all there is.
    nodes = stored(union([_children(r) for r in [*levels[1:], *(tops if sources > 1 else [tops[0].limit(0)])]]), "merkle-nodes")
    summit = (tops if sources > 1 else levels)[-1].select(here).first()
    reached = F.col("up") == _run_id(*[F.lit(x) for x in (summit["id"] if summit else (TOP, 0, 0))])
    step = 1
    while nodes.where(~reached).limit(1).count():
        # What lies ``step`` runs up is in the top tree or of that level at least.
        ancestors = nodes.where((F.col("id.level") >= step) | (F.col("id.scope") == TOP))
        ancestors = ancestors.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        jumped = lookup(nodes.where(~reached), ancestors, ["up"], limit=BROADCAST_BYTES // (step * FANOUT * 32))
        jumped = jumped.select("id", F.col("next").alias("up"), F.concat("path", "more").alias("path"))
        nodes = stored(nodes.where(reached).unionByName(jumped), "merkle-nodes")
        step *= 2

    segments = nodes.where("id.level = 0").select("id", "path")
    none = F.array().cast(nodes.schema["path"].dataType)
    runs = lookup(levels[0].select(here, "scope", "items", "alone"), roots.select("scope", F.col("digest").alias("subroot")), ["scope"])
    each = runs.join(segments, "id", "left").select("items", "alone", "subroot", F.coalesce("path", none).alias("path"), F.posexplode("items").alias("at", "item"))
    own_segment = F.when(F.col("alone"), none).otherwise(F.array(_beside(F.col("items"), F.col("at"))))
    return each.select(F.col("item.id").alias("id"), _hex(F.col("item.digest")).alias("leaf"), _hex(F.col("item.altered")).alias("altered_leaf"),
                       _hex(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), F.concat(own_segment, "path").alias("proof"))
