"""Feature groups and embedding tables: lookup, pooling, concatenation.

An embedding table is a DataFrame ``(fid, id, vec)``; a lookup is a join. Id 0
is padding and always gives the zero vector.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.catalog import Catalog
from featlake.functions.ids import as_column, in_vocab_or_zero
from featlake.operators.sequence import domain_length
from featlake.session import write_and_read

# A table is sent to every task only if its vectors stay below this size.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Lists up to this long are pooled slot by slot when the table is broadcast.
MAX_SLOTS = 16
# Ids of the large form that one task adds up; more of them take more tasks.
POOLED_IDS = 250_000


def fits_broadcast(table: DataFrame, width: int, limit: int | None = None) -> bool:
    """Size check before a broadcast: counted rows times bytes per vector."""
    limit = MAX_BROADCAST_BYTES if limit is None else limit
    return table.count() * (4 * width + 32) <= limit


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def _feature_table(table: DataFrame, fid: int, key: str, vec: str) -> DataFrame:
    return table.filter(F.col("fid") == fid).select(F.col("id").alias(key), F.col("vec").alias(vec))


def _join_key(df: DataFrame, id_column: str) -> Column:
    """Padding ids get spread-out negative keys: they match nothing and share no partition."""
    spread = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30))
    return F.when(F.col(id_column) > 0, F.col(id_column)).otherwise(spread)


def lookup(
    df: DataFrame, id_column: str, fid: int, table: DataFrame, width: int, name: str = "vec", limit: int | None = None
) -> DataFrame:
    """Add the vector of one id per row. A large table is joined by shuffle.

    In the shuffled form a hot id is split by adaptive skew join; the side that
    repeats ids is the preserved left side, which it may cut.
    """
    small = fits_broadcast(table.filter(F.col("fid") == fid), width, limit)
    vectors = _feature_table(table, fid, "_key", "_vec")
    keyed = df.withColumn("_key", F.col(id_column) if small else _join_key(df, id_column))
    joined = keyed.join(F.broadcast(vectors) if small else vectors.hint("merge"), "_key", "left")
    found = F.when(F.col(id_column) > 0, F.col("_vec"))
    return joined.select(*df.columns, F.coalesce(found, zeros(width)).alias(name))


def lookup_concat(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[tuple[int | None, str]],
    table: DataFrame,
    width: int,
    name: str = "vec",
    limit: int | None = None,
) -> DataFrame:
    """Add the concatenated vectors of several id columns, in the given order.

    ``features`` lists (fid, id column); a fid of None is a skipped feature and
    gives zeros. With a small table every lookup is a broadcast join and rows
    never move. With a large one the ids go through one join in long form and
    come back together by a number given to each row, so rows that repeat ``keys``
    stay apart; the other columns travel with them.
    """
    used = [f for f, _ in features if f is not None]
    if not used:
        return df.withColumn(name, zeros(width * len(features)))
    if fits_broadcast(table.filter(F.col("fid").isin(used)), width, limit):
        joined, parts = df, []
        for i, (fid, column) in enumerate(features):
            if fid is None:
                parts.append(zeros(width))
                continue
            vectors = F.broadcast(_feature_table(table, fid, f"_k{i}", f"_v{i}"))
            joined = joined.join(vectors, F.col(column) == F.col(f"_k{i}"), "left")
            parts.append(F.coalesce(F.when(F.col(column) > 0, F.col(f"_v{i}")), zeros(width)))
        return joined.select(*df.columns, F.concat(*parts).alias(name))
    cells = [
        F.struct(F.lit(i).alias("_pos"), F.lit(fid).cast("bigint").alias("fid"), F.col(column).cast("bigint").alias("id"))
        for i, (fid, column) in enumerate(features)
    ]
    numbered = write_and_read(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    long = numbered.select(*numbered.columns, F.inline(F.array(*cells)))
    long = long.withColumn("id", F.when(F.col("fid").isNull(), F.lit(0)).otherwise(F.col("id")))
    keyed = long.withColumn("_key", _join_key(long, "id")).drop("id")
    vectors = table.select(F.col("fid"), F.col("id").alias("_key"), "vec")
    keyed = keyed.withColumn("fid", F.coalesce("fid", F.lit(-1)))
    found = keyed.join(vectors.hint("merge"), ["fid", "_key"], "left")
    cell = F.struct("_pos", F.coalesce("vec", zeros(width)).alias("vec"))
    joined = found.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in df.columns],
        F.flatten(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["vec"])).alias(name),
    )
    return joined.select(*df.columns, name)


def bag_mean(
    df: DataFrame,
    keys: Sequence[str],
    ids: str,
    n_slots: int,
    fid: int,
    table: DataFrame,
    width: int,
    name: str = "vec",
    limit: int | None = None,
) -> DataFrame:
    """Mean vector of the positive ids among the first ``n_slots`` of a list; zeros when there is none.

    Null and empty lists give zeros. Rows that repeat ``keys`` are pooled one by one.

    Small table: one broadcast join per slot and no shuffle at all. Otherwise
    ids are exploded and joined, vectors are brought to their row as they are, and averaged there as
    ``width`` plain aggregates. A row's ids lie in many tasks of the join, so sums made before the shuffle would be as many as
    the ids, and a task would hold them all; a task of the shuffle holds the sums of about POOLED_IDS ids.
    Only ``keys`` are kept.
    """
    df = df.select(*keys, F.slice(ids, 1, n_slots).alias(ids))
    count = F.greatest(F.coalesce(F.array_size(F.filter(F.col(ids), lambda x: x > 0)), F.lit(0)), F.lit(1))
    if n_slots <= MAX_SLOTS and fits_broadcast(table.filter(F.col("fid") == fid), width, limit):
        joined = df.select(*keys, count.alias("_n"), *[F.get(ids, F.lit(i)).alias(f"_i{i}") for i in range(n_slots)])
        for i in range(n_slots):
            vectors = F.broadcast(_feature_table(table, fid, f"_k{i}", f"_v{i}"))
            on = (F.col(f"_i{i}") == F.col(f"_k{i}")) & (F.col(f"_i{i}") > 0)
            joined = joined.join(vectors, on, "left")
        def total(d: Column) -> Column:
            values = [F.coalesce(F.get(f"_v{i}", d).cast("double"), F.lit(0.0)) for i in range(n_slots)]
            return reduce(lambda a, b: a + b, values)

        mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: total(d) / F.col("_n"))
        return joined.select(*keys, mean.alias(name))
    numbered = write_and_read(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    long = numbered.select(*keys, "_row", F.posexplode_outer(ids).alias("_pos", "_id"))
    keyed = long.withColumn("_key", _join_key(long, "_id"))
    vectors = _feature_table(table, fid, "_key", "_vec")
    joined = keyed.join(vectors.hint("merge"), "_key", "left")
    sums = [F.coalesce(F.sum(F.get("_vec", F.lit(d)).cast("double")), F.lit(0.0)) for d in range(width)]
    n = F.greatest(F.count_if(F.col("_id") > 0), F.lit(1))
    n_ids = numbered.agg(F.sum(F.greatest(F.coalesce(F.array_size(ids), F.lit(0)), F.lit(1)))).first()[0] or 0
    n_tasks = -(-n_ids // POOLED_IDS)
    # below the session's number, adaptive execution may merge small tasks
    own = [n_tasks] if n_tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    placed = joined.select(*keys, "_row", "_id", "_vec").repartition(*own, "_row")
    pooled = placed.groupBy("_row").agg(*[F.first(k).alias(k) for k in keys], F.array(*[s / n for s in sums]).alias(name))
    return pooled.select(*keys, name)


def sequence_vectors(
    df: DataFrame,
    catalog: Catalog,
    domain: str,
    keys: Sequence[str],
    max_len: int,
    table: DataFrame,
    width: int,
    skip_above: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """One row per (sample, position): the concatenated vectors of all side-info slots."""
    features = catalog.side_info(domain)
    length = domain_length(catalog, domain, max_len)
    rows = (
        df.select(*keys, length.alias("_len"), *[f.column for f in features])
        .filter(F.col("_len") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("pos"))
    )
    ids = rows.select(
        *keys, "pos", *[in_vocab_or_zero(F.get(f.column, F.col("pos")), f.vocab).alias(f"_id{f.slot}") for f in features]
    )
    slots = [(None if is_skipped(f.vocab, skip_above) else f.fid, f"_id{f.slot}") for f in features]
    return lookup_concat(ids, [*keys, "pos"], slots, table, width, limit=limit).select(*keys, "pos", "vec")


def is_skipped(vocab: int, skip_above: int = 0) -> bool:
    """True for a feature that gets no table: no vocabulary, or a larger one than wanted."""
    return vocab <= 0 or 0 < skip_above < vocab


def per_slot_vocab(catalog: DataFrame) -> DataFrame:
    """One row per position of the flattened id vectors, with that position's vocabulary."""
    return catalog.filter(F.col("grp").isin("user_int", "item_int")).select(
        "grp", "fid", "offset", F.posexplode(F.array_repeat("vocab", F.col("dim"))).alias("i", "vocab")
    ).select("grp", "fid", (F.col("offset") + F.col("i")).alias("position"), "vocab")


def feature_specs(catalog: DataFrame) -> DataFrame:
    """(grp, fid, vocab, offset, length): largest vocabulary over a feature's positions."""
    return per_slot_vocab(catalog).groupBy("grp", "fid").agg(
        F.max("vocab").alias("vocab"),
        F.min("position").cast("int").alias("offset"),
        F.count(F.lit(1)).cast("int").alias("length"),
    )


def unknown_group_fids(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Group entries whose fid is not in the catalog."""
    known = catalog.select(F.col("grp").alias("side"), "fid")
    return groups.join(known, ["side", "fid"], "left_anti").select("side", "group_name", "pos", "fid")


def require_known_groups(groups: DataFrame, catalog: DataFrame) -> None:
    """Raise one error that lists every unknown fid; both inputs are configuration."""
    bad = unknown_group_fids(groups, catalog).orderBy("side", "group_name", "pos").collect()
    if bad:
        names = ", ".join(f"{r['side']}/{r['group_name']}: {r['fid']}" for r in bad)
        raise KeyError(f"groups name features that are not in the catalog: {names}")


def group_positions(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Groups of fids turned into groups of catalog positions."""
    slots = catalog.select(F.col("grp").alias("side"), "fid", F.col("slot").alias("position"))
    return groups.join(slots, ["side", "fid"]).select("side", "group_name", "pos", "fid", "position")


def singleton_groups(catalog: DataFrame) -> DataFrame:
    """Without a groups document every id feature is a group of its own."""
    return catalog.filter(F.col("grp").isin("user_int", "item_int")).select(
        F.col("grp").alias("side"),
        F.concat(F.lit("F"), "fid").alias("group_name"),
        F.lit(0).alias("pos"),
        "fid",
        F.col("slot").alias("position"),
    )


def cardinality_triage(
    catalog: DataFrame, skip_above: int = 0, id_above: int = 10000, reset_above: int | None = None
) -> DataFrame:
    """Per id feature: skipped (no table), id-like (large), reset (relearned each epoch)."""
    vocab = as_column("vocab")
    skipped = vocab <= 0
    if skip_above > 0:
        skipped = skipped | (vocab > skip_above)
    reset = F.lit(False) if reset_above is None else ~skipped & (vocab > reset_above)
    return catalog.filter((F.col("grp") != "user_dense") & ~F.col("is_ts")).select(
        "grp", "domain", "fid", "vocab",
        skipped.alias("skipped"), (vocab > id_above).alias("id_like"), reset.alias("reset"),
    )


def triage_counts(triage: DataFrame) -> DataFrame:
    return triage.groupBy("grp", "domain").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("skipped").alias("n_skipped"),
        F.count_if("id_like").alias("n_id_like"),
        F.count_if("reset").alias("n_reset"),
        F.count_if(~F.col("skipped") & ~F.col("reset")).alias("n_kept"),
    )
