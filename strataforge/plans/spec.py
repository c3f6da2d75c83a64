"""What a leveled table is: its keys, payload and shape."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class TableSpec:
    """Payload columns have the indices 2, 3, ... in a delta's value_map: 0 is the partition key, 1 the row id."""

    partition_key: str
    row_id: str
    payload: tuple[str, ...]
    spread: int = 4
    last_level: int = 2
    relation_id: int = 1
    #: "replace": a later delta replaces an earlier one whole; "merge": each column keeps its last value.
    delta_policy: str = "replace"

    def __post_init__(self):
        if self.spread < 2 or self.last_level < 1:
            raise ValueError("spread must be 2 or more and last_level 1 or more")
        if len(self.payload) > 30:
            raise ValueError("a value map addresses 30 payload columns at most")
        if self.delta_policy not in ("replace", "merge"):
            raise ValueError("delta_policy is 'replace' or 'merge'")
        if len({self.partition_key, self.row_id, *self.payload}) != len(self.payload) + 2:
            raise ValueError("column names must differ")

    def bit(self, column: str) -> int:
        return self.payload.index(column) + 2

    @property
    def columns(self) -> list[str]:
        return [self.partition_key, self.row_id, *self.payload]

    def as_dict(self) -> dict:
        return asdict(self) | {"payload": list(self.payload)}

    @staticmethod
    def of(told: dict) -> TableSpec:
        return TableSpec(**(told | {"payload": tuple(told["payload"])}))
