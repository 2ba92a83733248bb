"""The feature catalog: which columns exist, how wide they are, which ids are valid.

A catalog has one entry per feature column, so it is bounded by the width of the
sample table and is the only thing plans are built from on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession

GROUPS = ("user_int", "item_int", "user_dense", "seq")
COLUMN_PREFIX = {
    "user_int": "user_int_feats",
    "item_int": "item_int_feats",
    "user_dense": "user_dense_feats",
}
DEFAULT_MAX_LEN = 256

CATALOG_SCHEMA = (
    "grp string, domain string, fid bigint, column string, vocab bigint, "
    "dim int, offset int, slot int, is_ts boolean"
)


@dataclass(frozen=True)
class Feature:
    """One feature column. ``vocab`` is -1 where ids have no meaning (dense)."""

    grp: str
    fid: int
    column: str
    vocab: int = -1
    dim: int = 1
    offset: int = -1
    slot: int = 0
    domain: str = ""
    is_ts: bool = False


class Catalog:
    """Features in layout order, with the lookups plan building needs."""

    def __init__(self, features: Iterable[Feature]) -> None:
        self.features = tuple(_laid_out(list(features)))

    @classmethod
    def from_rows(cls, rows: Iterable[Row]) -> Catalog:
        """From collected catalog rows; slots give the order inside each group."""
        ordered = sorted(
            rows, key=lambda r: (GROUPS.index(r["grp"]), r["domain"], r["is_ts"], r["slot"])
        )
        return cls(
            Feature(
                grp=r["grp"], domain=r["domain"], fid=r["fid"], column=r["column"],
                vocab=r["vocab"], dim=r["dim"], is_ts=r["is_ts"],
            )
            for r in ordered
        )

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f.grp, f.domain, f.fid, f.column, f.vocab, f.dim, f.offset, f.slot, f.is_ts)
            for f in self.features
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)

    def group(self, grp: str) -> tuple[Feature, ...]:
        return tuple(f for f in self.features if f.grp == grp)

    @property
    def domains(self) -> tuple[str, ...]:
        return tuple(sorted({f.domain for f in self.group("seq")}))

    def side_info(self, domain: str) -> tuple[Feature, ...]:
        return tuple(f for f in self.group("seq") if f.domain == domain and not f.is_ts)

    def time_column(self, domain: str) -> Feature | None:
        return next((f for f in self.group("seq") if f.domain == domain and f.is_ts), None)

    def total_dim(self, grp: str) -> int:
        return sum(f.dim for f in self.group(grp))

    def find(self, grp: str, fid: int) -> Feature:
        for f in self.group(grp):
            if f.fid == fid:
                return f
        raise KeyError(f"feature {fid} is not in group {grp}")

    def with_time_columns(self, time_fids: dict[str, int]) -> Catalog:
        """Mark, per sequence domain, the feature that carries event times."""
        return Catalog(
            replace(f, is_ts=time_fids.get(f.domain) == f.fid) if f.grp == "seq" else f
            for f in self.features
        )

    def max_len(self, domain: str, seq_max_lens: dict[str, int] | None) -> int:
        return (seq_max_lens or {}).get(domain, DEFAULT_MAX_LEN)


def _laid_out(features: list[Feature]) -> Iterable[Feature]:
    """Number the slots of each group or domain and add up the offsets."""
    next_offset: dict[str, int] = {}
    next_slot: dict[tuple[str, str], int] = {}
    for f in features:
        key = (f.grp, f.domain)
        if f.grp == "seq":
            if f.is_ts:
                yield replace(f, slot=-1, offset=-1)
                continue
            offset = -1
        else:
            offset = next_offset.get(f.grp, 0)
            next_offset[f.grp] = offset + f.dim
        slot = next_slot.get(key, 0)
        next_slot[key] = slot + 1
        yield replace(f, slot=slot, offset=offset)
