"""A small cache of point reads on the driver."""

from __future__ import annotations

from collections import OrderedDict
from threading import Lock

# Fixed value: entries held.
CAPACITY = 1024


class PointCache:
    """Rows by (entity_type, entity_id, version); the row read longest ago goes first. Not for scans."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity if capacity > 0 else CAPACITY
        self._rows: OrderedDict[tuple, object] = OrderedDict()
        self._lock = Lock()

    def get(self, entity_type: str, entity_id: str, version: int):
        key = (entity_type, entity_id, version)
        with self._lock:
            if key in self._rows:
                self._rows.move_to_end(key)
            return self._rows.get(key)

    def put(self, entity_type: str, entity_id: str, version: int, row) -> None:
        with self._lock:
            self._rows[entity_type, entity_id, version] = row
            self._rows.move_to_end((entity_type, entity_id, version))
            while len(self._rows) > self.capacity:
                self._rows.popitem(last=False)

    def invalidate(self, entity_type: str, entity_id: str) -> int:
        """Forget an entity; returns how many rows went."""
        with self._lock:
            gone = [k for k in self._rows if k[:2] == (entity_type, entity_id)]
            for k in gone:
                del self._rows[k]
            return len(gone)

    def __len__(self) -> int:
        return len(self._rows)
