"""Directed acyclic and undirected graphs of variables. Models are small: they live on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations


class Dag:
    def __init__(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = ()) -> None:
        self._parents: dict[str, set[str]] = {}
        self._children: dict[str, set[str]] = {}
        for n in nodes:
            self.add_node(n)
        for a, b in edges:
            self.add_edge(a, b)

    def add_node(self, n: str) -> None:
        self._parents.setdefault(n, set())
        self._children.setdefault(n, set())

    def add_edge(self, a: str, b: str) -> None:
        if a == b or a in self._children and a in self.descendants(b):
            raise ValueError(f"{a} -> {b} would close a cycle")
        self.add_node(a)
        self.add_node(b)
        self._parents[b].add(a)
        self._children[a].add(b)

    @property
    def nodes(self) -> list[str]:
        return sorted(self._parents)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return sorted((p, c) for c, ps in self._parents.items() for p in ps)

    def parents(self, n: str) -> list[str]:
        return sorted(self._parents[n])

    def children(self, n: str) -> list[str]:
        return sorted(self._children[n])

    def roots(self) -> list[str]:
        return [n for n in self.nodes if not self._parents[n]]

    def leaves(self) -> list[str]:
        return [n for n in self.nodes if not self._children[n]]

    def _reach(self, start: Iterable[str], step: dict[str, set[str]]) -> set[str]:
        seen, todo = set(), list(start)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += step.get(n, ())
        return seen

    def ancestors(self, of: Iterable[str]) -> set[str]:
        """With the nodes themselves."""
        return self._reach(of, self._parents)

    def descendants(self, n: str) -> set[str]:
        """With the node itself."""
        return self._reach([n], self._children)

    def order(self) -> list[str]:
        out: list[str] = []
        left = {n: len(p) for n, p in self._parents.items()}
        ready = sorted(n for n, k in left.items() if not k)
        while ready:
            n = ready.pop(0)
            out.append(n)
            for c in self.children(n):
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
            ready.sort()
        return out

    def moral(self) -> Graph:
        pairs = [*self.edges, *(p for n in self.nodes for p in combinations(self.parents(n), 2))]
        return Graph(pairs, self.nodes)

    def active(self, start: str, given: Iterable[str] = ()) -> set[str]:
        """Nodes that an active trail from the start leads to: walked by node and direction of arrival."""
        seen_at = set(given)
        opened = self.ancestors(seen_at)
        todo, visited, out = [(start, "up")], set(), set()
        while todo:
            n, came = todo.pop()
            if (n, came) in visited:
                continue
            visited.add((n, came))
            if n not in seen_at:
                out.add(n)
            if came == "up" and n not in seen_at:
                todo += [(p, "up") for p in self._parents[n]] + [(c, "down") for c in self._children[n]]
            elif came == "down":
                if n not in seen_at:
                    todo += [(c, "down") for c in self._children[n]]
                if n in opened:
                    todo += [(p, "up") for p in self._parents[n]]
        return out

    def separated(self, x: str, y: str, given: Iterable[str] = ()) -> bool:
        return y not in self.active(x, given)

    def blanket(self, n: str) -> set[str]:
        out = self._parents[n] | self._children[n]
        for c in self._children[n]:
            out |= self._parents[c]
        return out - {n}

    def immoralities(self) -> set[tuple[frozenset[str], str]]:
        """(unlinked parents, their child)."""
        linked = {frozenset(e) for e in self.edges}
        return {(frozenset(p), n) for n in self.nodes for p in combinations(self.parents(n), 2) if frozenset(p) not in linked}

    def equivalent(self, other: Dag) -> bool:
        """The same independencies: equal skeletons and immoralities."""
        return self.nodes == other.nodes and {frozenset(e) for e in self.edges} == {frozenset(e) for e in other.edges} and self.immoralities() == other.immoralities()

    def local_independencies(self) -> list[tuple[str, frozenset[str], frozenset[str]]]:
        """(node, its non-descendants but for parents, given its parents)."""
        out = []
        for n in self.nodes:
            free = frozenset(set(self.nodes) - self.descendants(n) - self._parents[n])
            if free:
                out.append((n, free, frozenset(self._parents[n])))
        return out

    def independencies(self) -> list[tuple[str, frozenset[str], frozenset[str]]]:
        """Every node against all it is separated from, for each condition set. Exponential in the nodes."""
        out = []
        for n in self.nodes:
            rest = [x for x in self.nodes if x != n]
            for k in range(len(rest)):
                for z in combinations(rest, k):
                    free = frozenset(set(rest) - set(z) - self.active(n, z))
                    if free:
                        out.append((n, free, frozenset(z)))
        return out

    def do(self, n: str) -> Dag:
        """The graph after an intervention: without the edges into the node."""
        return Dag(((a, b) for a, b in self.edges if b != n), self.nodes)

    def paths(self, x: str, y: str) -> list[list[str]]:
        """Directed paths."""
        if x == y:
            return [[x]]
        return [[x, *p] for c in self.children(x) for p in self.paths(c, y)]


class Graph:
    def __init__(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = ()) -> None:
        self._near: dict[str, set[str]] = {n: set() for n in nodes}
        for a, b in edges:
            self.add_edge(a, b)

    def add_edge(self, a: str, b: str) -> None:
        if a == b:
            raise ValueError("a node can't be linked to itself")
        self._near.setdefault(a, set()).add(b)
        self._near.setdefault(b, set()).add(a)

    @property
    def nodes(self) -> list[str]:
        return sorted(self._near)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return sorted({tuple(sorted((a, b))) for a, near in self._near.items() for b in near})

    def near(self, n: str) -> set[str]:
        return set(self._near[n])

    def is_clique(self, nodes: Iterable[str]) -> bool:
        return all(b in self._near[a] for a, b in combinations(list(nodes), 2))

    def copy(self) -> Graph:
        return Graph(self.edges, self.nodes)

    def fill(self, n: str) -> list[tuple[str, str]]:
        """Links that eliminating the node would add."""
        return [(a, b) for a, b in combinations(sorted(self._near[n]), 2) if b not in self._near[a]]

    def without(self, n: str) -> Graph:
        """After the node's elimination."""
        g = self.copy()
        for a, b in self.fill(n):
            g.add_edge(a, b)
        for m in g._near.pop(n):
            g._near[m].discard(n)
        return g

    def is_chordal(self) -> bool:
        g = self
        while g.nodes:
            free = next((n for n in g.nodes if not g.fill(n)), None)
            if free is None:
                return False
            g = g.without(free)
        return True


def elimination_order(graph: Graph, states: dict[str, int], cost: str = "min_fill", nodes: Iterable[str] | None = None) -> list[str]:
    """Greedy by min_fill, min_neighbors, min_weight (product of the neighbours' states) or weighted_min_fill (sum of the products of each filled link's ends)."""

    def price(g: Graph, n: str) -> float:
        if cost == "min_fill":
            return len(g.fill(n))
        if cost == "min_neighbors":
            return len(g.near(n))
        if cost == "min_weight":
            out = 1
            for m in g.near(n):
                out *= states[m]
            return out
        if cost == "weighted_min_fill":
            return sum(states[a] * states[b] for a, b in g.fill(n))
        raise ValueError(f"unknown cost {cost}")

    left, out = set(graph.nodes if nodes is None else nodes), []
    while left:
        n = min(sorted(left), key=lambda x: price(graph, x))
        out.append(n)
        left.discard(n)
        graph = graph.without(n)
    return out


def triangulated(graph: Graph, states: dict[str, int], cost: str = "min_fill") -> tuple[Graph, list[frozenset[str]]]:
    """A chordal graph and its maximal cliques."""
    out, g, cliques = graph.copy(), graph, []
    for n in elimination_order(graph, states, cost):
        for a, b in g.fill(n):
            out.add_edge(a, b)
        cliques.append(frozenset({n} | g.near(n)))
        g = g.without(n)
    return out, sorted((c for c in set(cliques) if not any(c < d for d in cliques)), key=sorted)


def junction_tree(graph: Graph, states: dict[str, int]) -> tuple[list[frozenset[str]], list[tuple[frozenset[str], frozenset[str]]]]:
    """Cliques, and the links of a spanning forest with the largest separators."""
    _, cliques = triangulated(graph, states)
    links = sorted(((len(a & b), sorted(a), sorted(b), a, b) for a, b in combinations(cliques, 2) if a & b), key=lambda x: (-x[0], x[1], x[2]))
    home = {c: c for c in cliques}

    def find(c: frozenset[str]) -> frozenset[str]:
        while home[c] != c:
            c = home[c]
        return c

    tree = []
    for *_, a, b in links:
        if find(a) != find(b):
            home[find(a)] = find(b)
            tree.append((a, b))
    return cliques, tree
