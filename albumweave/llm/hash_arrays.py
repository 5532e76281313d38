"""Tables of 64-bit keys stored as sorted array files in the shared folder and memory-mapped by the workers.

A table is cut by key range into shards; a shard is one file of sorted keys and one file for each value. Workers map
only what they look up, so a table may be larger than any worker's memory."""

from __future__ import annotations

import numpy as np

from albumweave.llm.common import mapped, put


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def narrow(h: np.ndarray, width: int) -> bytes:
    """Numbers below 256 ** width in `width` bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def write_shard(folder: str, name: str, shard: int, keys: np.ndarray, **values: np.ndarray) -> None:
    """Write the shard's files; keys must be sorted and distinct."""
    put(folder, f"{name}-{shard}.keys", keys.astype("<u8").tobytes())
    for column, v in values.items():
        put(folder, f"{name}-{shard}.{column}", v.tobytes())


class HashArrays:
    """A reader of one table. `filled` lists the shards that were written."""

    def __init__(self, folder: str, name: str, shards: int, filled: list[int], **kinds: str) -> None:
        self.folder, self.name, self.shards, self.filled, self.kinds = folder, name, shards, set(filled), kinds
        self._open: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _shard(self, k: int) -> dict:
        if k not in self._open:
            at = f"{self.folder}/{self.name}-{k}"
            self._open[k] = {"keys": mapped(f"{at}.keys", "<u8")} | {c: mapped(f"{at}.{c}", t) for c, t in self.kinds.items()}
        return self._open[k]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(found, values) for sorted keys; values of keys that are not found are 0."""
        found = np.zeros(len(keys), bool)
        out = {c: np.zeros(len(keys), t) for c, t in self.kinds.items()}
        if not len(keys):
            return found, out
        cuts = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if k not in self.filled:
                continue
            a, b = int(cuts[k]), int(cuts[k + 1])
            own = self._shard(k)
            at = np.searchsorted(own["keys"], keys[a:b])
            at[at == len(own["keys"])] = 0
            hit = own["keys"][at] == keys[a:b]
            found[a:b] = hit
            for c in self.kinds:
                out[c][a:b][hit] = own[c][at[hit]]
        return found, out


def discounts(n: list[float]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from the numbers of items that were counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    usual = [0.0, 0.5, 0.8, 1.0]
    if n1 <= 0 or n2 <= 0:
        return np.array(usual)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else usual[2], 3 - 4 * y * n4 / n3 if n3 and n4 else usual[3]]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])
