"""Queries: embedding lookup, pooling and concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.functions.ids import equal_chunks
from featlake.operators import embed
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import ORACLES, query

WIDTH = t.EMBEDDING_WIDTH
CHUNKS = 5
#: Slots of the pooled feature; the operator itself cuts longer lists.
SLOTS = 8

SEQUENCE_CATALOG = Catalog(
    [
        Feature("seq", 1, "types", 6, domain="seq_a"),
        Feature("seq", 2, "ks", 100, domain="seq_a"),
        Feature("seq", 3, "times", 3_000_000_000, domain="seq_a"),
    ]
)
SEQUENCE_LEN = t.HISTORY


def digest(vec: str) -> list[Column]:
    """Sums that pin down a vector's values and their order: for computed vectors."""
    zero = F.lit(0.0)
    total = F.aggregate(vec, zero, lambda acc, x: acc + x)
    placed = F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), zero, lambda acc, x: acc + x)
    return [t.rounded(total).alias("total"), t.rounded(placed).alias("placed")]


def digest_sql(vec: str) -> str:
    doubles = f"list_transform({vec}, lambda x: x::DOUBLE)"
    placed = f"list_transform(range(0, len({vec})), lambda i: ({vec})[i + 1]::DOUBLE * (i + 1))"
    return f"{sql.r6(f'list_sum({doubles})')} AS total, {sql.r6(f'list_sum({placed})')} AS placed"


def probes(vec: str, positions: tuple[int, ...]) -> list[Column]:
    """Length and a few values: enough for vectors that are moved as a whole."""
    values = [t.rounded(F.get(vec, F.lit(p))).alias(f"v{p}") for p in positions]
    return [F.array_size(vec).alias("width"), *values]


def probes_sql(vec: str, positions: tuple[int, ...]) -> str:
    return f"len({vec})::INTEGER AS width, " + ", ".join(f"{sql.r6(f'({vec})[{p + 1}]')} AS v{p}" for p in positions)


ONE = (0, 17, 40, 63)
CUT = (0, 1, 17, 36, 37, 38)
THREE = (0, 40, 63, 64, 127, 128, 150, 191)


ZEROS = f"list_transform(range(0, {WIDTH}), lambda z: 0::FLOAT)"


@query(
    "embedding_lookup",
    f"""WITH {sql.EMBEDDING_TABLE},
found AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS id, coalesce(e.vec, {ZEROS}) AS vec
  FROM lineitem l LEFT JOIN emb e ON e.fid = 1 AND e.id = l.l_partkey AND e.id > 0)
SELECT l_orderkey, l_linenumber, l_partkey, {probes_sql('vec', ONE)} FROM found""",
)
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("id")
    )
    found = embed.lookup(rows, "id", 1, t.embedding_table(spark, sf), WIDTH)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", *probes("vec", ONE))


@query(
    "embedding_bag_mean",
    f"""WITH {sql.EMBEDDING_TABLE}, {sql.MULTIHOT},
ids AS (SELECT l_orderkey, list_slice(parts, 1, {SLOTS}) AS ids FROM multihot),
cells AS (
  SELECT l_orderkey, i, sum(coalesce(vec[i + 1], 0)::DOUBLE) / greatest(count(*) FILTER (WHERE id <> 0), 1) AS v
  FROM (SELECT b.l_orderkey, b.id, e.vec, unnest(range(0, {WIDTH})) AS i
        FROM (SELECT l_orderkey, unnest(ids) AS id FROM ids) b LEFT JOIN emb e ON e.fid = 1 AND e.id = b.id AND b.id > 0)
  GROUP BY l_orderkey, i),
pooled AS (SELECT l_orderkey, list(v ORDER BY i) AS vec FROM cells GROUP BY l_orderkey)
SELECT l_orderkey, {digest_sql('vec')} FROM pooled""",
)
def embedding_bag_mean(spark: SparkSession, sf: str) -> DataFrame:
    bags = t.multihot(spark, sf).select(
        "l_orderkey", F.col("parts").alias("ids")
    )
    pooled = embed.bag_mean(bags, ["l_orderkey"], "ids", SLOTS, 1, t.embedding_table(spark, sf), WIDTH)
    return pooled.select("l_orderkey", *digest("vec"))


BAG_SQL = ORACLES["embedding_bag_mean"]


@query("embedding_bag_mean_shuffled", BAG_SQL)
def embedding_bag_mean_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """The same means by the join for tables too large to send to the tasks."""
    bags = t.multihot(spark, sf).select(
        "l_orderkey", F.col("parts").alias("ids")
    )
    table = t.embedding_table(spark, sf)
    pooled = embed.bag_mean(bags, ["l_orderkey"], "ids", SLOTS, 1, table, WIDTH, limit=0)
    return pooled.select("l_orderkey", *digest("vec"))


def _pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.events(spark, sf).select(
        "event_id", F.col("k").alias("id_1"), F.col("user_id").alias("id_2")
    )


_PAIR_SQL = f"""{sql.EVENTS}, {sql.EMBEDDING_TABLE},
pairs AS (
  SELECT event_id, list_concat(coalesce(a.vec, {ZEROS}), {ZEROS}, coalesce(b.vec, {ZEROS})) AS vec
  FROM ev LEFT JOIN emb a ON a.fid = 1 AND a.id = ev.k
          LEFT JOIN emb b ON b.fid = 2 AND b.id = ev.user_id)"""


@query("group_concat_vec", f"WITH {_PAIR_SQL} SELECT event_id, {probes_sql('vec', THREE)} FROM pairs")
def group_concat_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Two looked-up features around a skipped one."""
    features = [(1, "id_1"), (None, "id_1"), (2, "id_2")]
    found = embed.lookup_concat(_pair_rows(spark, sf), ["event_id"], features, t.embedding_table(spark, sf), WIDTH)
    return found.select("event_id", *probes("vec", THREE))


@query("group_concat_vec_shuffled", ORACLES["group_concat_vec"])
def group_concat_vec_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors by the join for tables too large to send to the tasks."""
    features = [(1, "id_1"), (None, "id_1"), (2, "id_2")]
    table = t.embedding_table(spark, sf)
    found = embed.lookup_concat(_pair_rows(spark, sf), ["event_id"], features, table, WIDTH, limit=0)
    return found.select("event_id", *probes("vec", THREE))


_WIDE_LEN = 3 * WIDTH
_CHUNK = -(-_WIDE_LEN // CHUNKS)


@query(
    "vector_chunks",
    f"""WITH {_PAIR_SQL},
padded AS (SELECT event_id, list_transform(range(0, {_CHUNK * CHUNKS}), lambda i: coalesce(vec[i + 1], 0::FLOAT)) AS vec FROM pairs),
cut AS (SELECT event_id, c::INTEGER AS chunk, list_slice(vec, c * {_CHUNK} + 1, (c + 1) * {_CHUNK}) AS part
        FROM (SELECT event_id, vec, unnest(range(0, {CHUNKS})) AS c FROM padded))
SELECT event_id, chunk, {probes_sql('part', CUT)} FROM cut""",
)
def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    features = [(1, "id_1"), (None, "id_1"), (2, "id_2")]
    found = embed.lookup_concat(_pair_rows(spark, sf), ["event_id"], features, t.embedding_table(spark, sf), WIDTH)
    parts = found.select("event_id", F.posexplode(equal_chunks("vec", _WIDE_LEN, CHUNKS)).alias("chunk", "part"))
    return parts.select("event_id", "chunk", *probes("part", CUT))


@query(
    "seq_vectors",
    f"""WITH {sql.EVENT_HISTORY}, {sql.EMBEDDING_TABLE},
positions AS (SELECT event_id, types, ks, unnest(range(0, least(len(types), {SEQUENCE_LEN}))) AS pos FROM hist_a),
ids AS (SELECT event_id, pos::INTEGER AS pos,
               CASE WHEN types[pos + 1] > 0 AND types[pos + 1] < 6 THEN types[pos + 1] ELSE 0 END AS id_1,
               CASE WHEN ks[pos + 1] > 0 AND ks[pos + 1] < 100 THEN ks[pos + 1] ELSE 0 END AS id_2 FROM positions),
vecs AS (SELECT event_id, pos, list_concat(coalesce(a.vec, {ZEROS}), coalesce(b.vec, {ZEROS}), {ZEROS}) AS vec
         FROM ids LEFT JOIN emb a ON a.fid = 1 AND a.id = id_1 LEFT JOIN emb b ON b.fid = 2 AND b.id = id_2)
SELECT event_id, pos, {probes_sql('vec', THREE)} FROM vecs""",
)
def seq_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Per position the vectors of type and k; the large time vocabulary is skipped."""
    found = embed.sequence_vectors(
        t.event_history(spark, sf), SEQUENCE_CATALOG, "seq_a", ["event_id"], SEQUENCE_LEN,
        t.embedding_table(spark, sf), WIDTH, skip_above=1_000_000,
    )
    return found.select("event_id", "pos", *probes("vec", THREE))
