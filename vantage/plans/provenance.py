"""What earlier steps did to the rows that are looked at."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Provenance:
    rows_are_groups: bool = False
    gaps_were_shaped: bool = False
    rows_were_removed: bool = False

    def after(self, steps: list) -> Provenance:
        """With the steps of a further recipe."""
        return Provenance(
            self.rows_are_groups or any(s.op == "aggregate" for s in steps),
            self.gaps_were_shaped or any(s.shapes_gaps for s in steps),
            self.rows_were_removed or any(s.removes_rows for s in steps),
        )
