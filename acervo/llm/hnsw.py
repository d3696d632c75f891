"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Many vectors move through the graph together: one step of a walk expands the best open node
of every query at once.  Vectors are added in batches; those of one batch also see each
other, so copies that come together are linked like copies that come one after another.
"""

from __future__ import annotations

import io

import numpy as np

#: Links of a node on the ground level (half of it above), nodes held while linking, vectors added together.
LINKS, BUILD_BEAM, BATCH = 24, 40, 256
#: Cells of the table of visited nodes of one walk.
VISITED = 32_000_000


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the rows of two arrays of unit vectors, exact for small ones too."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(a - b, axis=-1) / 2, 1))


class Graph:
    def __init__(self, length: int, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.count, self.top, self.entry = 0, 0, 0
        self.vectors = np.zeros((0, length), np.float32)
        self.links = [np.full((0, LINKS), -1, np.int32)]
        self.slots: list[np.ndarray] = [np.zeros(0, np.int32)]  # row of a node in the links of a level above the ground

    def neighbours(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.links[level][nodes if level == 0 else self.slots[level][nodes]]

    def walk(self, queries: np.ndarray, start: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``beam`` nearest nodes found on a level, nearest first; -1 where there are fewer."""
        n = len(queries)
        nodes, cosines = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
        seen = np.zeros((n, self.count), bool)
        start = start[:, :beam]
        known = np.einsum("qkd,qd->qk", self.vectors[start], queries)
        known[start < 0] = -np.inf
        order = np.argsort(-known, axis=1)
        nodes[:, :start.shape[1]] = np.take_along_axis(start, order, axis=1)
        cosines[:, :start.shape[1]] = np.take_along_axis(known, order, axis=1)
        q, k = np.nonzero(start >= 0)
        seen[q, start[q, k]] = True
        done = nodes < 0
        active = np.arange(n)
        while True:
            is_open = ~done[active]
            pick = is_open.argmax(axis=1)
            more = is_open[np.arange(len(active)), pick]
            active, pick = active[more], pick[more]
            if not len(active):
                return nodes, cosines
            done[active, pick] = True
            around = self.neighbours(level, nodes[active, pick])
            fresh = (around >= 0) & ~seen[active[:, None], around]
            q, k = np.nonzero(fresh)
            target = around[q, k]
            seen[active[q], target] = True
            known = np.full(around.shape, -np.inf, np.float32)
            known[q, k] = np.einsum("ij,ij->i", self.vectors[target], queries[active[q]])
            every = np.concatenate([cosines[active], known], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            cosines[active] = np.take_along_axis(every, order, axis=1)
            nodes[active] = np.take_along_axis(np.concatenate([nodes[active], np.where(fresh, around, -1)], axis=1), order, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the nearest nodes found from the top of the graph down."""
        step = max(16, min(1024, VISITED // max(1, self.count)))
        found = [self._search(queries[at:at + step], beam) for at in range(0, len(queries), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(queries), 1), self.entry, np.int32)
        for level in range(self.top, 0, -1):
            start = self.walk(queries, start, 4, level)[0]
        return self.walk(queries, start, beam, 0)

    def chosen(self, near: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's nodes, nearest first: those nearer to the row's node than to one already chosen, then the rest."""
        out = np.full((len(near), most), -1, np.int32)
        for at in range(0, len(near), 1024):
            nodes, own = near[at:at + 1024], cosines[at:at + 1024]
            vectors = self.vectors[nodes]
            mutual = vectors @ vectors.transpose(0, 2, 1)
            kept, hidden = np.zeros(nodes.shape, bool), nodes < 0
            for c in range(nodes.shape[1]):
                take = ~hidden[:, c] & (kept.sum(axis=1) < most)
                kept[:, c] = take
                hidden |= take[:, None] & (mutual[:, c] > own)
            rank = np.where(nodes < 0, 2, ~kept).astype(np.int8)
            order = np.argsort(rank, axis=1, kind="stable")[:, :most]
            picked = np.take_along_axis(nodes, order, axis=1)
            out[at:at + 1024, :picked.shape[1]] = picked
        return out

    def add(self, vectors: np.ndarray) -> None:
        """Add unit vectors; they get the next numbers."""
        for at in range(0, len(vectors), BATCH):
            self._add(vectors[at:at + BATCH].astype(np.float32))

    def _add(self, batch: np.ndarray) -> None:
        first, n = self.count, len(batch)
        levels = (-np.log(1 - self.rng.random(n)) / np.log(LINKS // 2)).astype(int)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if first:
            start = np.full((n, 1), self.entry, np.int32)
            for level in range(self.top, -1, -1):
                found[level] = self.walk(batch, start, 16 if level else BUILD_BEAM, level)
                start = found[level][0]
        self.count += n
        self.vectors = np.concatenate([self.vectors, batch])
        self.links[0] = np.concatenate([self.links[0], np.full((n, LINKS), -1, np.int32)])
        while len(self.links) <= levels.max():
            self.links.append(np.full((0, LINKS // 2), -1, np.int32))
            self.slots.append(np.full(first, -1, np.int32))
        mutual = batch @ batch.T
        np.fill_diagonal(mutual, -np.inf)
        for level, links in enumerate(self.links):
            own = np.flatnonzero(levels >= level)
            if level:
                slots = np.full(n, -1, np.int32)
                slots[own] = len(links) + np.arange(len(own))
                self.slots[level] = np.concatenate([self.slots[level], slots])
                self.links[level] = np.concatenate([links, np.full((len(own), LINKS // 2), -1, np.int32)])
            if not len(own):
                continue
            mates = mutual[np.ix_(own, own)]
            nearest = np.argsort(-mates, axis=1)[:, :LINKS // 2]
            beside = np.where(np.isfinite(np.take_along_axis(mates, nearest, axis=1)), first + own[nearest], -1).astype(np.int32)
            near, cosines = beside, np.take_along_axis(mates, nearest, axis=1)
            if level in found:
                near, cosines = np.concatenate([found[level][0][own], near], axis=1), np.concatenate([found[level][1][own], cosines], axis=1)
            order = np.argsort(-cosines, axis=1, kind="stable")
            near, cosines = np.take_along_axis(near, order, axis=1), np.take_along_axis(cosines, order, axis=1)
            self._link(level, first + own, self.chosen(near, cosines, LINKS // 2))
        if levels.max() >= self.top:
            self.top = int(levels.max())
            self.entry = first + int(levels.argmax())

    def _link(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Link new nodes to the chosen ones and back; a node with too many links chooses among them."""
        links = self.links[level]
        rows = lambda at: at if level == 0 else self.slots[level][at]
        links[rows(nodes), :chosen.shape[1]] = chosen
        q, k = np.nonzero(chosen >= 0)
        back, new = chosen[q, k], nodes[q]
        order = np.lexsort((-np.einsum("ij,ij->i", self.vectors[back], self.vectors[new]), back))
        back, new = back[order], new[order]
        targets, begins, counts = np.unique(back, return_index=True, return_counts=True)
        nth = np.arange(len(back)) - np.repeat(begins, counts)
        few = nth < 8
        extra = np.full((len(targets), 8), -1, np.int32)
        extra[np.repeat(np.arange(len(targets)), counts)[few], nth[few]] = new[few]
        old = links[rows(targets)]
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1  # mates that chose each other
        near = np.concatenate([old, extra], axis=1)
        cosines = np.einsum("qkd,qd->qk", self.vectors[near], self.vectors[targets])
        cosines[near < 0] = -np.inf
        order = np.argsort(-cosines, axis=1, kind="stable")
        near, cosines = np.take_along_axis(near, order, axis=1), np.take_along_axis(cosines, order, axis=1)
        full = (near >= 0).sum(axis=1) > links.shape[1]
        kept = near[:, :links.shape[1]].copy()
        if full.any():
            kept[full] = self.chosen(near[full], cosines[full], links.shape[1])
        links[rows(targets)] = kept

    def to_bytes(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        upper = {f"{name}{level}": own[level] for level in range(1, len(self.links)) for name, own in (("links", self.links), ("slots", self.slots))}
        np.savez(out, state=np.array([self.count, self.top, self.entry, len(self.links)]), links0=self.links[0], vectors32=self.vectors, **upper, **more)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> tuple["Graph", dict[str, np.ndarray]]:
        held = dict(np.load(io.BytesIO(data)))
        graph = Graph(held["vectors32"].shape[1])
        graph.count, graph.top, graph.entry, levels = map(int, held.pop("state"))
        graph.vectors, graph.links = held.pop("vectors32"), [held.pop(f"links{level}") for level in range(levels)]
        graph.slots = [np.zeros(0, np.int32), *[held.pop(f"slots{level}") for level in range(1, levels)]]
        return graph, held
