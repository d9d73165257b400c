"""Who may see which records, as a column expression."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What a reader was granted.  Nothing granted shows nothing; ``everything`` shows all."""

    grants: dict[str, tuple[str, ...]] = field(default_factory=dict)  # provider -> connection ids
    principals: tuple[str, ...] = ()
    public: bool = True
    everything: bool = False

    @classmethod
    def of(cls, pairs: Iterable[tuple[str, str]], principals: Iterable[str] = (), public: bool = True) -> Scope:
        """Grants from (provider, connection id) pairs, whatever their order and case."""
        found: dict[str, set[str]] = {}
        for provider, connection in pairs:
            found.setdefault(provider.strip().lower(), set()).add(connection.strip())
        return cls({p: tuple(sorted(c)) for p, c in sorted(found.items())}, tuple(sorted(set(principals))), public)

    def allows(self, provider: Column, connection: Column, record_key: Column, principals: Column, public: Column) -> Column:
        """Public records, those of a granted connection, and those that share a principal."""
        if self.everything:
            return F.lit(True)
        ways = []
        if self.public:
            ways.append(F.coalesce(public, F.lit(False)))
        for name, connections in self.grants.items():
            prefix = F.lit(False)
            for c in connections:
                prefix = prefix | record_key.startswith(f"{name}:{c}:")
            ways.append(F.coalesce((F.lower(provider) == name) & (connection.isin(*connections) | prefix), F.lit(False)))
        if self.principals:
            ways.append(F.coalesce(F.arrays_overlap(principals, F.array(*[F.lit(p) for p in self.principals])), F.lit(False)))
        out = F.lit(False)
        for way in ways:
            out = out | way
        return out
