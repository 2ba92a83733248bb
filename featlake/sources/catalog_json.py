"""Feature catalog and feature groups as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featlake.catalog import COLUMN_PREFIX

# Feature ids are values, not keys, so a fixed type reads every catalog document.
DOCUMENT_TYPE = (
    "user_int array<array<bigint>>, item_int array<array<bigint>>, "
    "user_dense array<array<bigint>>, "
    "seq map<string, struct<prefix: string, ts_fid: bigint, features: array<array<bigint>>>>"
)
GROUPS_TYPE = "user_ns_groups map<string, string>, item_ns_groups map<string, string>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Long catalog from a ``schema.json`` document."""
    return parse_catalog(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")), "doc")


def parse_catalog(documents: DataFrame, column: str) -> DataFrame:
    """Long catalog from a column of catalog documents (normally a single row).

    All groups are turned into one list of entries and exploded together, so
    the documents are read once. Text that isn't JSON and a document without one of
    the groups raise an error that says so.
    """
    parsed = documents.select(F.from_json(column, DOCUMENT_TYPE, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    doc = parsed.select(
        *[F.coalesce(c, F.raise_error(F.lit(f"catalog document without the group {c}"))).alias(c) for c in ("user_int", "item_int", "user_dense", "seq")]
    )
    flat = [_flat_entries(grp) for grp in COLUMN_PREFIX]
    sequences = F.flatten(F.transform(F.map_entries("seq"), lambda s: _sequence_entries(s["key"], s["value"])))
    entries = doc.select(F.inline(F.concat(*flat, sequences)))
    # The catalog has one row per column of the sample table, so windows over
    # it stay small however large the data is.
    before = Window.partitionBy("grp", "domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("dim").over(before), F.lit(0))
    slot = F.coalesce(F.count_if(~F.col("is_ts")).over(before), F.lit(0))
    return entries.select(
        "grp",
        "domain",
        "fid",
        "column",
        "vocab",
        "dim",
        F.when(F.col("grp") == "seq", F.lit(-1)).otherwise(offset).cast("int").alias("offset"),
        F.when(F.col("is_ts"), F.lit(-1)).otherwise(slot).cast("int").alias("slot"),
        "is_ts",
    )


def _entry(grp: Column, domain: Column, pos: Column, fid: Column, prefix: Column, vocab: Column, dim: Column, is_ts: Column) -> Column:
    return F.struct(
        grp.alias("grp"),
        domain.alias("domain"),
        pos.alias("pos"),
        fid.alias("fid"),
        F.concat(prefix, F.lit("_"), fid.cast("string")).alias("column"),
        vocab.cast("bigint").alias("vocab"),
        dim.cast("int").alias("dim"),
        is_ts.alias("is_ts"),
    )


def _flat_entries(grp: str) -> Column:
    dense = grp == "user_dense"

    def entry(f: Column, i: Column) -> Column:
        vocab = F.lit(-1) if dense else F.get(f, F.lit(1))
        dim = F.get(f, F.lit(1 if dense else 2))
        return _entry(
            F.lit(grp), F.lit(""), i, F.get(f, F.lit(0)), F.lit(COLUMN_PREFIX[grp]), vocab, dim, F.lit(False)
        )

    return F.transform(grp, entry)


def _sequence_entries(domain: Column, s: Column) -> Column:
    def entry(f: Column, i: Column) -> Column:
        fid = F.get(f, F.lit(0))
        return _entry(
            F.lit("seq"), domain, i, fid, s["prefix"], F.get(f, F.lit(1)), F.lit(1), fid.eqNullSafe(s["ts_fid"])
        )

    return F.transform(s["features"], entry)


def catalog_document(catalog: DataFrame) -> DataFrame:
    """One row holding the catalog as a JSON document: the inverse of :func:`parse_catalog`.

    The catalog's rows, one per column of the sample table, are collected into
    a single list once and every part of the document is cut out of that list.
    """
    dim = F.col("dim").cast("bigint")
    row = F.struct("grp", "domain", "slot", "fid", "vocab", dim.alias("dim"), "column", "is_ts")
    rows = F.col("rows")

    def part(grp: str, *fields: str) -> Column:
        return F.transform(F.filter(rows, lambda r: r["grp"] == grp), lambda r: F.array(*[r[f] for f in fields]))

    seq = F.filter(rows, lambda r: r["grp"] == "seq")

    def domain_entry(domain: Column) -> Column:
        mine = F.filter(seq, lambda r: r["domain"] == domain)
        return F.struct(
            domain.alias("key"),
            F.struct(
                F.regexp_replace(F.get(mine, F.lit(0))["column"], r"_\d+$", "").alias("prefix"),
                F.get(F.filter(mine, lambda r: r["is_ts"]), F.lit(0))["fid"].alias("ts_fid"),
                F.transform(mine, lambda r: F.array(r["fid"], r["vocab"])).alias("features"),
            ).alias("value"),
        )

    domains = F.array_distinct(F.transform(seq, lambda r: r["domain"]))
    document = F.struct(
        part("user_int", "fid", "vocab", "dim").alias("user_int"),
        part("item_int", "fid", "vocab", "dim").alias("item_int"),
        part("user_dense", "fid", "dim").alias("user_dense"),
        F.map_from_entries(F.transform(domains, domain_entry)).alias("seq"),
    )
    return catalog.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        F.to_json(document, {"ignoreNullFields": "false"}).alias("doc")
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Write the catalog document as text; it is a few kilobytes at most."""
    catalog_document(catalog).coalesce(1).write.mode("overwrite").text(path)


def layout_document(catalog: DataFrame, grp: str) -> DataFrame:
    """JSON of one group's layout: ``entries`` of (fid, offset, length) and ``total_dim``."""
    entry = F.struct("slot", F.array("fid", F.col("offset").cast("bigint"), F.col("dim").cast("bigint")).alias("e"))
    return catalog.filter(F.col("grp") == grp).agg(
        F.to_json(
            F.struct(
                F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("entries"),
                F.sum("dim").alias("total_dim"),
            )
        ).alias("doc")
    )


def read_layout(documents: DataFrame, column: str) -> DataFrame:
    """(slot, fid, offset, length) rows from a layout document."""
    kind = "entries array<array<bigint>>, total_dim bigint"
    return (
        documents.select(F.from_json(column, kind).alias("d"))
        .select(F.posexplode("d.entries").alias("slot", "e"))
        .select(
            "slot",
            F.get("e", F.lit(0)).alias("fid"),
            F.get("e", F.lit(1)).cast("int").alias("offset"),
            F.get("e", F.lit(2)).cast("int").alias("length"),
        )
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(side, group_name, pos, fid) rows from a groups document; notes are skipped."""
    return parse_groups(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")), "doc")


def parse_groups(documents: DataFrame, column: str) -> DataFrame:
    """(side, group_name, pos, fid) rows of groups documents.

    Names that start with an underscore are notes, whatever they hold. A document that isn't a JSON object and a group that
    isn't a list of ids raise when the rows are read; a side that is absent has no groups.
    """
    strict = {"mode": "FAILFAST"}
    parsed = F.from_json(column, GROUPS_TYPE, strict)
    whole = F.when(parsed.isNull(), F.raise_error(F.lit("groups document is empty"))).otherwise(parsed)
    doc = documents.select(whole.alias("d")).select("d.*")
    sides = F.array(
        F.struct(F.lit("user_int").alias("side"), F.col("user_ns_groups").alias("named")),
        F.struct(F.lit("item_int").alias("side"), F.col("item_ns_groups").alias("named")),
    )
    given = doc.select(F.inline(sides)).select("side", F.explode("named").alias("group_name", "text"))
    groups = given.filter(~F.col("group_name").startswith("_"))
    fids = F.from_json("text", "array<bigint>", strict)
    named = F.concat(F.lit("feature group "), F.col("group_name"), F.lit(" isn't a list of ids"))
    listed = F.when(fids.isNull() | F.exists(fids, lambda x: x.isNull()), F.raise_error(named)).otherwise(fids)
    return groups.select("side", "group_name", F.posexplode(listed).alias("pos", "fid"))
