"""Random tree sequences by subtree moves, and plain answers about them."""

import random


class Simulated:
    """trees: for each tree, parents by child; edges: (left, right, parent, child), tree t holding on [t, t + 1). low: only samples move, beside samples of
    at most this depth, so that trees stay low."""

    def __init__(self, samples, trees, seed, reuse=0.5, low=None):
        rng = random.Random(seed)
        self.n, self.trees = samples, []
        top, nodes, parent = samples, list(range(samples)), {}
        while len(nodes) > 1:  # a balanced first tree
            nodes = nodes[2:] + [top]
            old = [c for c in range(top) if c not in parent][:2]
            for c in old:
                parent[c] = top
            nodes = [c for c in range(top + 1) if c not in parent]
            top += 1
        opened, self.edges, changed = {}, [], list(parent.items())
        for t in range(trees):
            for c, p in changed:
                opened[c] = (p, t)
            self.trees.append(dict(parent))
            before = dict(parent)
            inner = [c for c in parent if parent[c] in parent]
            x = rng.choice([c for c in inner if c < samples] if low else inner)
            u = parent[x]
            (s,) = (c for c in parent if parent[c] == u and c != x)
            parent[s] = parent.pop(u)
            del parent[x]
            below = {x}
            grown = True
            while grown:
                more = {c for c, p in parent.items() if p in below} - below
                below |= more
                grown = bool(more)
            places = [c for c in parent if c not in below and c != s and (not low or c < samples)]
            y = rng.choice(places)
            while low and self._deeper(parent, y, low):
                y = rng.choice(places)
            v = u if rng.random() < reuse else top
            top += v == top
            parent[v], parent[y], parent[x] = parent[y], v, v
            changed = [(c, p) for c, p in parent.items() if before.get(c) != p]
            for c, p in before.items():
                if parent.get(c) != p:
                    self.edges.append((float(opened[c][1]), float(t + 1), p, c))
        self.edges += [(float(opened[c][1]), float(trees), p, c) for c, p in before.items() if parent.get(c) == p]
        self.top = top

    @staticmethod
    def _deeper(parent, u, depth):
        while depth and u in parent:
            u, depth = parent[u], depth - 1
        return u in parent

    def tables(self, spark, sites=(), mutations=()):
        from grovewise.model import EDGES, MUTATIONS, NODES, SITES, TreeTables

        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        nodes = ((i, i < self.n, None, None, None) for i in range(self.top))
        return TreeTables(make(nodes, NODES), make(self.edges, EDGES), make(sites, SITES), make(mutations, MUTATIONS), float(len(self.trees)))

    def mutated(self, spark, count, seed):
        """Tables with a site in the middle of many trees, and mutations on any nodes."""
        rng = random.Random(seed)
        sites, mutations = [], []
        for i, t in enumerate(sorted(rng.choices(range(len(self.trees)), k=count))):
            sites.append((i, t + 0.5, rng.choice("ACGT")))
            nodes = sorted(set(self.trees[t]) | set(self.trees[t].values()))
            done = {}
            # above first, so that parents come before their descendants
            for u in sorted(rng.sample(nodes, min(len(nodes), rng.randrange(4))), key=lambda u: self.depth(t, u)):
                above = next((done[a] for a in self.above(t, u)[1:] if a in done), None)
                done[u] = len(mutations)
                mutations.append((len(mutations), i, u, rng.choice("ACGT"), above, None))
        return self.tables(spark, sites, mutations)

    def above(self, t, u):
        way = [u]
        while way[-1] in self.trees[t]:
            way.append(self.trees[t][way[-1]])
        return way

    def depth(self, t, u):
        return len(self.above(t, u))

    def children(self, t):
        out = {}
        for c, p in self.trees[t].items():
            out.setdefault(p, []).append(c)
        return {p: sorted(x) for p, x in out.items()}

    def walk(self, t):
        """Nodes in postorder, children by id, without recursion."""
        kids = self.children(t)
        (root,) = set(kids) - set(self.trees[t])
        out, todo = [], [(root, False)]
        while todo:
            u, done = todo.pop()
            if done or u not in kids:
                out.append(u)
            else:
                todo.append((u, True))
                todo += [(c, False) for c in reversed(kids[u])]
        return out, kids, root
