"""Tables kept by name: uploads, and results of recipes kept as their recipes, with lineage and expiry."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from .operators.dashboard import Dashboard, look
from .operators.profile import understood
from .plans import recipe as R
from .plans.provenance import Provenance
from .table import Table

#: How deep and wide derived tables go, and how much is kept at hand.
MAX_DEPTH, MAX_CHILDREN = 10, 20
CACHED_TABLES, CACHED_LOOKS = 4, 16


class Missing(KeyError):
    """No such table, or it belongs to somebody else, or its time is up."""


class Full(RuntimeError):
    """There is no room for another table."""


@dataclass
class Entry:
    id: str
    owner: str
    name: str
    expires: float
    parent: str | None = None
    recipe: R.Recipe | None = None
    source: Table | None = None
    children: list[str] = field(default_factory=list)


def size_of(table: Table) -> int:
    """Catalyst's estimate of a table's bytes; 0 where it has none."""
    size = int(str(table.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 62 else size


class Store:
    """Derived tables are lazy plans over their parents. A few are persisted on the executors, the least recently used
    making room; a table that was let go is planned again from its recipe.

    Uploads and kept results share `budget` bytes, if given. For a new one the oldest kept results are let go first, as
    any of them can be made again; an upload is never let go for another, so one that still does not fit is refused."""

    def __init__(self, seconds: float = 3600, per_owner: int = 20, total: int = 200, clock: Callable[[], float] = time.monotonic, budget: int | None = None):
        self.seconds, self.per_owner, self.total, self.clock, self.budget = seconds, per_owner, total, clock, budget
        self._sizes: dict[str, int] = {}
        self._entries: dict[str, Entry] = {}
        self._tables: OrderedDict[str, Table] = OrderedDict()
        self._looks: OrderedDict[str, Dashboard] = OrderedDict()
        self._lock = threading.RLock()
        self._running: dict[str, threading.Lock] = {}

    def add(self, owner: str, name: str, table: Table) -> Entry:
        """An upload; its columns are understood once."""
        known = table if table.meanings else understood(table)
        with self._lock:
            self._make_room(owner)
            size = size_of(known)
            self._fit(size)
            entry = Entry(uuid.uuid4().hex, owner, name, self.clock() + self.seconds, source=known)
            self._entries[entry.id] = entry
            self._sizes[entry.id] = size
            return entry

    def derive(self, owner: str, parent_id: str, recipe: R.Recipe) -> Entry:
        """A recipe's result as a table of its own. It lives as long as the upload it comes from."""
        with self._lock:
            parent = self.get(owner, parent_id)
            if len(self.lineage(owner, parent_id)) >= MAX_DEPTH:
                raise Full(f"Derived tables are at most {MAX_DEPTH} deep.")
            if len(parent.children) >= MAX_CHILDREN:
                raise Full(f"A table has at most {MAX_CHILDREN} derived ones.")
        table = R.derive(self.table(owner, parent_id), recipe)
        with self._lock:
            parent = self.get(owner, parent_id)
            self._make_room(owner)
            entry = Entry(uuid.uuid4().hex, owner, parent.name, parent.expires, parent_id, recipe)
            self._entries[entry.id] = entry
            parent.children.append(entry.id)
            self._keep(entry.id, table)
            return entry

    def is_kept(self, table_id: str) -> bool:
        """Whether a derived table's rows are at hand."""
        return table_id in self._tables

    def get(self, owner: str, table_id: str) -> Entry:
        with self._lock:
            self.expire()
            entry = self._entries.get(table_id)
            if entry is None or entry.owner != owner:
                raise Missing(table_id)
            return entry

    def table(self, owner: str, table_id: str) -> Table:
        """The table itself: kept, or planned again along its lineage."""
        with self._lock:
            entry = self.get(owner, table_id)
            if entry.source is not None:
                return entry.source
            if table_id in self._tables:
                self._tables.move_to_end(table_id)
                return self._tables[table_id]
        table = R.run(self.table(owner, entry.parent), entry.recipe).table
        with self._lock:
            return self._keep(table_id, table)

    def _keep(self, table_id: str, table: Table) -> Table:
        """The table, persisted if there is room for it; one that another caller has made meanwhile is taken."""
        if table_id in self._tables:
            return self._tables[table_id]
        size = size_of(table)
        if self.budget is not None and sum(self._sizes[k] for k in self._sizes if k not in self._tables) + size > self.budget:
            return table  # beside the uploads there is no room: planned again each time
        self._fit(size)
        kept = table.with_frame(table.frame.persist())
        self._tables[table_id], self._sizes[table_id] = kept, size
        while len(self._tables) > CACHED_TABLES:
            self._let_go()
        return kept

    def _let_go(self) -> None:
        """Of the kept results the one that was used least recently."""
        table_id, old = self._tables.popitem(last=False)
        self._sizes.pop(table_id, None)
        old.frame.unpersist()

    def _fit(self, size: int) -> None:
        if self.budget is None:
            return
        while self._tables and sum(self._sizes.values()) + size > self.budget:
            self._let_go()
        if sum(self._sizes.values()) + size > self.budget:
            raise Full(f"The table takes {size:,} bytes, more than is left of {self.budget:,}.")

    def lineage(self, owner: str, table_id: str) -> list[Entry]:
        """From the upload down to the table."""
        entry = self.get(owner, table_id)
        return ([*self.lineage(owner, entry.parent)] if entry.parent else []) + [entry]

    def steps(self, owner: str, table_id: str) -> int:
        return sum(len(e.recipe.steps) for e in self.lineage(owner, table_id) if e.recipe)

    def title(self, owner: str, table_id: str) -> str:
        n = self.steps(owner, table_id)
        name = self.get(owner, table_id).name
        return f"{name} ({n} step{'' if n == 1 else 's'})" if n else name

    def provenance(self, owner: str, table_id: str) -> Provenance:
        out = Provenance()
        for entry in self.lineage(owner, table_id):
            out = out.after(entry.recipe.steps) if entry.recipe else out
        return out

    def look(self, owner: str, table_id: str) -> Dashboard:
        """The dashboard, computed once for callers that ask at the same time and kept for later ones."""
        self.get(owner, table_id)
        with self._lock:
            if table_id in self._looks:
                self._looks.move_to_end(table_id)
                return self._looks[table_id]
            single = self._running.setdefault(table_id, threading.Lock())
        with single:
            with self._lock:
                if table_id in self._looks:
                    return self._looks[table_id]
            try:
                found = look(self.table(owner, table_id), self.provenance(owner, table_id))
                self.get(owner, table_id)  # it may have expired meanwhile
            finally:
                with self._lock:
                    self._running.pop(table_id, None)
            with self._lock:
                self._looks[table_id] = found
                while len(self._looks) > CACHED_LOOKS:
                    self._looks.popitem(last=False)
                return found

    def remove(self, owner: str, table_id: str) -> None:
        """The table and all that is derived from it."""
        with self._lock:
            entry = self.get(owner, table_id)
            if entry.parent in self._entries:
                self._entries[entry.parent].children.remove(table_id)
            self._forget(table_id)

    def _forget(self, table_id: str) -> None:
        entry = self._entries.pop(table_id, None)
        if entry is None:
            return
        if table := self._tables.pop(table_id, None):
            table.frame.unpersist()
        self._sizes.pop(table_id, None)
        self._looks.pop(table_id, None)
        for child in entry.children:
            self._forget(child)

    def expire(self) -> None:
        with self._lock:
            for table_id in [k for k, e in self._entries.items() if e.expires <= self.clock()]:
                self._forget(table_id)

    def _make_room(self, owner: str) -> None:
        self.expire()
        if sum(e.owner == owner for e in self._entries.values()) >= self.per_owner:
            raise Full(f"At most {self.per_owner} tables are kept for one owner.")
        if len(self._entries) >= self.total:
            raise Full("There is no room for another table.")
