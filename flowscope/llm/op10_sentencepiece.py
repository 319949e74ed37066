"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has a node at every character and an edge for every piece of the vocabulary (UTF-8 bytes where a
character has none). Pieces never hold an inner word boundary, so that the lattice is a chain of small ones, one per word,
which a task builds once per distinct word and keeps in a table of bounded size. Merge ranks give the weights: a piece of
rank r has probability proportional to 1 / (r + SHIFT). Backward sums turn weights into conditional probabilities, so a
segmentation is a chain of decisions whose probabilities multiply.

Every segmentation has a Gumbel-perturbed log probability; the k largest are a sample without replacement. Perturbed A*
search finds them without listing all: a region is the set of segmentations that share the decisions before some place
and differ from known ones there. Its mass is known, so the largest perturbed value inside is a truncated Gumbel draw,
and an exact bound. The search takes the region with the largest value, draws its segmentation, and splits what is left
at each later decision. The value of the (k + 1)th is the threshold kappa: a segmentation of log probability l has the
inclusion score 1 - exp(-exp(l - kappa)).

All draws are hashes of the row's key, the draw, and the place, so that results depend on the row alone.

Defined cases: a null or empty text has one, empty segmentation; a text with fewer than k segmentations gives all of
them, each with inclusion score 1; rows that repeat an id draw alike; a null id draws as key 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import exp, expm1, inf, log

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table
from flowscope.plans.registry import query

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 3
SEED = 20_24
SHIFT = 2.7
MARK = "▁"
# Edges of the lattices that a task keeps (some 24 bytes each), and characters of the texts that it looks at together. Both
# bound memory whatever the length of words; a longer text is looked at alone.
KNOWN = 1_250_000
SLICE = 270_000
# Regions of a segmentation that the search holds one by one.
BLOCK = 64
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
U = np.uint64


STEP = U(0x9E3779B97F4A7C15)
ALL = (1 << 64) - 1
SLOT_BITS, SPREAD = 19, 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + STEP
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fraction(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def mixed_int(x: int) -> int:
    """``mixed`` of one number; far cheaper than an array of one."""
    x = (x + 0x9E3779B97F4A7C15) & ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def chance(key: int, name: int, at: int = 0) -> float:
    """A number in (0, 1)."""
    return ((mixed_int(mixed_int(mixed_int(key) ^ name) + at) >> 11) + 0.5) / (1 << 53)


def stream(key: int, name: int, n: int) -> np.ndarray:
    """n numbers in (0, 1)."""
    start = U(mixed_int(mixed_int(key) ^ name))
    return fraction(mixed(start + np.arange(n, dtype=U) * U(0xD1342543DE82EF95)))


class Pieces:
    """Ids, weights and bytes of a model's pieces, and a table of the hashes of all their prefixes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        total = log(sum(1 / (r + SHIFT) for r in range(n)))
        self.weight = np.full(n, -log(n + SHIFT) - total)
        self.weight[ranked] = [-log(r + SHIFT) - total for r in range(len(ranked))]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        # Ids of ASCII characters that only their byte stands for.
        self.single = np.array([self.byte_id.get(c, -1) for c in range(128)] + [-1])
        self.text = [b""] * n
        prefixes: dict[int, int] = {}
        for i in ranked:
            piece = sp.id_to_piece(i)
            self.text[i] = piece.replace(MARK, " ").encode()
            h = 0
            for c in piece[:-1]:
                h = self.next_hash(h, ord(c))
                prefixes.setdefault(h, -1)
            prefixes[self.next_hash(h, ord(piece[-1]))] = i
        for byte, i in self.byte_id.items():
            self.text[i] = bytes([byte])
        # Prefixes in an open table: a hash stands at its slot or at the next free one.
        slots = 1 << SLOT_BITS
        hashes, values = [0] * slots, [-1] * slots
        for h, i in prefixes.items():
            at = ((h * SPREAD) % (1 << 64)) >> (64 - SLOT_BITS)
            while hashes[at]:
                at = (at + 1) % slots
            hashes[at], values[at] = h, i
        self.prefix, self.piece = np.array(hashes, U), np.array(values, np.int32)
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.size = np.fromiter(map(len, self.text), np.int64, n)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def next_hash(h: int, code: int) -> int:
        return (h * int(STEP) + code + 1) % (1 << 64)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and the piece that each is, or -1."""
        at = ((hashes * U(SPREAD)) >> U(64 - SLOT_BITS)).astype(np.int64)
        here = self.prefix[at]
        known = here == hashes
        piece = np.where(known, self.piece[at], -1)
        open_ = np.flatnonzero(~known & (here > 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << SLOT_BITS) - 1)
            here = self.prefix[at]
            same = here == hashes[open_]
            known[open_[same]], piece[open_[same]] = True, self.piece[at[same]]
            going = ~same & (here > 0)
            open_, at = open_[going], at[going]
        return known, piece

    def bytes_of(self, code: int) -> list[int]:
        return [self.byte_id[b] for b in chr(code).encode()]

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of segmentations side by side, each without the boundary before its first word, and where they end."""
        size, start = self.size[ids], self.start[ids]
        first = (np.cumsum(counts) - counts)[counts > 0]
        size[first] -= 1
        start[first] += 1
        behind = np.cumsum(size)
        flat = self.flat[np.arange(behind[-1] if len(ids) else 0) + np.repeat(start - behind + size, size)]
        return flat, np.append(0, behind)[np.cumsum(counts)]

    def decoded(self, ids: list[int]) -> str:
        """The text of a segmentation; the boundary before the first word is not part of it."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode(errors="replace")


class Numbers(dict):
    """Numbers words in the order in which they are first asked for, and remembers the ones that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Lattices:
    """Lattices of words side by side: edges sorted by the node they leave, with conditional probabilities.

    An edge's label is the id of its piece, or the vocabulary's size plus the code point of a character without one.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.kept: dict[str, tuple[np.ndarray, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.kept = {name: (room, 0) for name, (room, _) in self.kept.items()}
        self.grow(first_node=np.zeros(0, np.int64), first_edge=np.zeros(1, np.int64), target=np.zeros(0, np.int32), log_p=np.zeros(0), bound=np.zeros(0), label=np.zeros(0, np.int32))

    def grow(self, **more: np.ndarray) -> None:
        """Append to the arrays of these names; their room grows by a quarter where it does not suffice."""
        for name, values in more.items():
            room, used = self.kept.get(name, (values[:0], 0))
            if used + len(values) > len(room):
                wider = np.empty(max(used + len(values), 5 * len(room) // 4), values.dtype)
                wider[:used] = room[:used]
                room = wider
            room[used : used + len(values)] = values
            self.kept[name] = room, used + len(values)
            setattr(self, name, room[: used + len(values)])

    def add(self, words: list[str]) -> None:
        """Lattices of words that have none yet, all at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.repeat(np.cumsum(lengths), lengths)
        base = len(self.first_edge) - 1
        nodes = base + np.arange(len(codes)) + np.repeat(np.arange(len(words)), lengths)
        spans, labels = [], []
        live, hashes, size = np.arange(len(codes)), np.zeros(len(codes), U), 0
        plain = np.zeros(len(codes), bool)
        while len(live):
            hashes = hashes * STEP + (codes[live + size] + 1).astype(U)
            known, piece = self.pieces.found(hashes)
            size += 1
            is_piece = piece >= 0
            spans.append((live[is_piece], size))
            labels.append(piece[is_piece])
            if size == 1:
                plain[live[is_piece]] = True
            going = known & (live + size < ends[live])
            live, hashes = live[going], hashes[going]
        spans.append((np.flatnonzero(~plain), 1))
        single = self.pieces.single[np.minimum(codes[~plain], 128)]
        labels.append(np.where(single >= 0, single, self.pieces.n + codes[~plain]))
        # Edges by the character they leave; long pieces first: they are the likely ones, and draws look from the front.
        ways = np.bincount(np.concatenate([i for i, _ in spans]), minlength=len(codes))
        place = np.cumsum(ways) - ways
        start = np.repeat(np.arange(len(codes), dtype=np.int32), ways)
        size, label = np.empty(len(start), np.int32), np.empty(len(start), np.int32)
        for (i, n), pieces in zip(reversed(spans), reversed(labels), strict=True):
            size[place[i]], label[place[i]] = n, pieces
            place[i] += 1
        weight = self.pieces.weight[np.minimum(label, self.pieces.n - 1)]
        raw = label >= self.pieces.n
        if raw.any():
            weight[raw] = self.pieces.weight.min() * np.array([len(chr(c).encode()) for c in label[raw] - self.pieces.n])
        # Sums over all ways to the end of the word, from the last characters backward.
        behind = np.zeros(base + len(codes) + len(words) + 1)
        source, target = nodes[start], nodes[start] + size
        left = ends[start] - start
        # Short numbers sort by their digits.
        by_left = np.argsort(left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, (left.max() if len(left) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_left[a:b]
            value = weight[e] + behind[target[e]]
            heads = np.flatnonzero(np.concatenate([[True], source[e][1:] != source[e][:-1]]))
            top = np.maximum.reduceat(value, heads)
            runs = np.diff(np.append(heads, len(e)))
            behind[source[e][heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, runs)), heads))
        log_p = np.minimum(0.0, weight + behind[target] - behind[source])
        heads = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
        runs = np.diff(np.append(heads, len(source)))
        log_p[heads[runs == 1]] = 0.0
        total = np.cumsum(np.exp(log_p))
        within = np.minimum(1.0, total - np.repeat(total[heads] - np.exp(log_p[heads]), runs))
        within[heads + runs - 1] = 1.0
        edges = np.bincount(source - base, minlength=len(codes) + len(words))
        self.grow(
            first_node=base + np.cumsum(lengths + 1) - lengths - 1, first_edge=self.first_edge[-1] + np.cumsum(edges), target=target.astype(np.int32),
            label=label.astype(np.int32), log_p=log_p, bound=source + within,
        )

    def siblings(self, edge: int) -> np.ndarray:
        node = int(np.searchsorted(self.first_edge, edge, "right")) - 1
        return np.arange(self.first_edge[node], self.first_edge[node + 1])

    def ids_of(self, edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segmentations side by side, and how many each has; a character without a piece is as many as it has bytes."""
        labels = self.label[edges]
        raw = np.flatnonzero(labels >= self.pieces.n)
        if not len(raw):
            return labels, counts
        spelt = [self.pieces.bytes_of(x - self.pieces.n) for x in labels[raw].tolist()]
        ways = np.ones(len(labels), np.int64)
        ways[raw] = [len(ids) for ids in spelt]
        total = np.append(0, np.cumsum(ways))
        out = np.repeat(labels, ways)
        out[out >= self.pieces.n] = [i for ids in spelt for i in ids]
        ends = total[np.cumsum(counts)]
        return out, np.diff(ends, prepend=0)


def drawn(lattices: Lattices, words: np.ndarray, keys: np.ndarray, places: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """One segmentation of every word place: its edges in order, and how many each place has."""
    first_node, first_edge, target, bound = lattices.first_node, lattices.first_edge, lattices.target, lattices.bound
    live, node, step = np.arange(len(words)), first_node[words], 0
    state = mixed(mixed(keys) ^ U(draw)) + places.astype(U) * U(0xD1342543DE82EF95)
    at, edges = [], []
    while len(live):
        wanted = node + fraction(mixed(state[live] ^ (U(step) << U(48))))
        edge = first_edge[node]
        behind = np.flatnonzero(bound[edge] < wanted)
        while len(behind):
            edge[behind] += 1
            behind = behind[bound[edge[behind]] < wanted[behind]]
        at.append(live)
        edges.append(edge)
        node = target[edge]
        going = first_edge[node] < first_edge[node + 1]
        live, node, step = live[going], node[going], step + 1
    # A place is in the first so many steps: its edges go side by side.
    counts = np.zeros(len(words), np.int64)
    for step, live in enumerate(at):
        counts[live] = step + 1
    first = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.int64)
    for step, (live, edge) in enumerate(zip(at, edges, strict=True)):
        out[first[live] + step] = edge
    return out, counts


def truncated(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value in regions of these log masses, none above ``bound``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = mass - np.log(np.exp(mass - bound) - np.log(u))
    return np.where(np.isneginf(mass), -inf, value)


def masses_of(p: np.ndarray, before: np.ndarray | float) -> np.ndarray:
    """Log mass of what leaves a segmentation at each decision, along the last axis."""
    with np.errstate(divide="ignore"):
        return before + np.cumsum(p, axis=-1) - p + np.where(p < 0, np.log(-np.expm1(p)), -inf)


class Found:
    """A segmentation, its regions from decision ``since`` on, and what is already excluded at that decision.

    The first ``BLOCK`` regions stand alone; all later ones are one region, ``tail``, until the search asks for it.
    """

    def __init__(self, edges, value, since, excluded, ends, key, draw):
        self.edges, self.value, self.since, self.excluded, self.ends, self.key, self.draw = edges, value, since, excluded, ends, key, draw

    def best(self) -> float:
        return max(self.top, self.tail)

    def take(self) -> tuple[int, float]:
        """The region with the largest value, which leaves the search."""
        if self.tail > self.top:
            self.open_tail()
        place, value = int(self.regions.argmax()), self.top
        self.regions[place] = -inf
        self.top = float(self.regions.max())
        return place, value

    def open_tail(self) -> None:
        """Split the tail: the largest value falls to a region by mass, the others lie below it."""
        at = self.since + BLOCK
        masses = masses_of(self.p[at:], float(self.p[:at].sum()))
        shares = np.cumsum(np.exp(masses - masses.max()))
        values = truncated(masses, self.tail, stream(self.key, 3000 + self.draw, len(masses)))
        pick = np.searchsorted(shares, shares[-1] * chance(self.key, 5000 + self.draw))
        values[min(int(pick), len(values) - 1)] = self.tail
        self.regions, self.top, self.tail = np.concatenate([self.regions, values]), self.tail, -inf


def sums_from(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of ``values``; an empty run gives 0."""
    cuts = np.stack([starts, starts + sizes], 1).ravel()
    return np.where(sizes > 0, np.add.reduceat(np.append(values, 0.0), cuts)[::2], 0.0)


def opened(lattices: Lattices, found: list[Found]) -> None:
    """The values of the regions of many segmentations of one draw, at once."""
    log_p = lattices.log_p
    sizes = np.array([len(f.edges) for f in found])
    since = np.array([f.since for f in found])
    value = np.array([f.value for f in found])
    keys = np.array([f.key for f in found], U)
    draw = found[0].draw
    starts = np.cumsum(sizes) - sizes
    p = log_p[np.concatenate([f.edges for f in found])]
    totals, before = sums_from(p, starts, sizes), sums_from(p, starts, since)
    shared = before + sums_from(p, starts + since, np.minimum(BLOCK, sizes - since))
    places = since[:, None] + np.arange(BLOCK)
    inside = places < sizes[:, None]
    near = np.where(inside, np.append(p, 0.0)[np.where(inside, starts[:, None] + places, 0)], 0.0)
    masses = np.where(inside, masses_of(near, before[:, None]), -inf)
    for i, f in enumerate(found):
        if f.excluded and f.since < len(f.edges):
            now = float(near[i, 0])
            left = 1 - sum(exp(log_p[e]) for e in (*f.excluded, f.edges[f.since]))
            open_ways = len(lattices.siblings(f.edges[f.since])) > len(f.excluded) + 1
            masses[i, 0] = masses[i, 0] - log(-expm1(now)) + log(left) if left > 1e-12 and open_ways and now < 0 else -inf
    named = mixed(mixed(keys) ^ U(1000 + draw))
    drawn_at = fraction(mixed(named[:, None] + np.arange(BLOCK, dtype=U) * U(0xD1342543DE82EF95)))
    regions = truncated(masses, value[:, None], drawn_at)
    tops = regions.max(axis=1)
    rest = shared - totals
    for i, f in enumerate(found):
        f.p, f.log_p = p[starts[i] : starts[i] + sizes[i]], float(totals[i])
        f.regions, f.top, f.tail = regions[i], float(tops[i]), -inf
        if f.since + BLOCK < sizes[i] and rest[i] > 0:
            mass = float(shared[i]) + log(-expm1(-float(rest[i])))
            f.tail = mass - log(exp(mass - f.value) - log(chance(f.key, 4000 + draw)))


def branched(lattices: Lattices, found: list[Found]) -> tuple[Found, int] | None:
    """The next segmentation of a row as far as the word in which it leaves the one it comes from, and that word."""
    first_edge, target, log_p, bound = lattices.first_edge, lattices.target, lattices.log_p, lattices.bound
    best = max(found, key=Found.best)
    if best.best() == -inf:
        return None
    place, value = best.take()
    at, key, draw = best.since + place, best.key, len(found)
    excluded = (*(best.excluded if place == 0 else ()), int(best.edges[at]))
    ways = [e for e in lattices.siblings(best.edges[at]).tolist() if e not in excluded]
    weights = np.cumsum(np.exp(log_p[ways]))
    edge = ways[min(int(np.searchsorted(weights, weights[-1] * chance(key, 2000 + draw))), len(ways) - 1)]
    inner, step = [edge], 1
    node = int(target[edge])
    while first_edge[node] < first_edge[node + 1]:
        a, b = int(first_edge[node]), int(first_edge[node + 1])
        edge = a + min(int(bound[a:b].searchsorted(node + chance(key, 2000 + draw, step))), b - a - 1)
        inner.append(edge)
        node = int(target[edge])
        step += 1
    word = int(np.searchsorted(best.ends, at, "right"))
    edges = np.concatenate([best.edges[:at], np.array(inner, np.int64)])
    return Found(edges, value, at, excluded, np.append(best.ends[:word], len(edges)), key, draw), word


def top_k(lattices: Lattices, keys: np.ndarray, words: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[list[Found]], list[float]]:
    """Per row the k largest perturbed segmentations, and the value of the next. ``words`` are those of all rows in order.

    All rows take a step together; what a segmentation draws anew is only its words behind the branch.
    """
    starts = np.cumsum(counts) - counts
    edges, n = drawn(lattices, words, np.repeat(keys, counts), np.arange(len(words)) - np.repeat(starts, counts), 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    rows: list[list[Found]] = []
    for key, a, b in zip(keys.tolist(), starts.tolist(), (starts + counts).tolist(), strict=True):
        rows.append([Found(edges[ends[a] : ends[b]], -log(-log(chance(key, 999))), 0, (), ends[a + 1 : b + 1] - ends[a], key, 0)])
    opened(lattices, [found[0] for found in rows])
    live = list(range(len(rows)))
    for draw in range(1, k):
        begun = [(i, b) for i in live if (b := branched(lattices, rows[i])) is not None]
        live = [i for i, _ in begun]
        if not live:
            break
        first = np.array([starts[i] + word + 1 for i, (_, word) in begun])
        size = starts[live] + counts[live] - first
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        edges, n = drawn(lattices, words[at], np.repeat(keys[live], size), at - np.repeat(starts[live], size), draw)
        ends = np.concatenate([[0], np.cumsum(n)])
        to = np.cumsum(size)
        for (i, (f, _)), a, b in zip(begun, to - size, to, strict=True):
            f.ends = np.concatenate([f.ends, len(f.edges) + ends[a + 1 : b + 1] - ends[a]])
            f.edges = np.concatenate([f.edges, edges[ends[a] : ends[b]]])
            rows[i].append(f)
        opened(lattices, [rows[i][-1] for i in live])
    # The next value is all that the threshold takes; its segmentation is not drawn.
    return rows, [max(f.best() for f in found) for found in rows]


# The lattices that this worker has built, of the last model it met; tasks of one job share them.
READY: dict[bytes, Lattices] = {}


def ready(model: bytes) -> Lattices:
    if model not in READY:
        READY.clear()
        READY[model] = Lattices(Pieces(model))
    return READY[model]


def words_in(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


OUT = pa.schema([("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decodes", pa.bool_())])


def sampled(batches: Iterator[pa.RecordBatch], model: bytes, k: int, seed: int, digest: bool, decode: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of each text's k segmentations; with ``digest`` also the number of ids and their SHA-256 (32-bit, little-endian), with
    ``decode`` the text that they stand for."""
    lattices = ready(model)
    for batch in batches:
        texts, docs = batch.column("body"), batch.column("doc").to_pylist()
        row = 0
        while row < batch.num_rows:
            if len(lattices.label) > KNOWN:
                lattices.clear()
            first, chars, bodies, words, counts = row, 0, [], [], []
            while row < batch.num_rows and chars < SLICE:
                bodies.append(texts[row].as_py())
                chars += len(bodies[-1]) + 1
                mine = words_in(bodies[-1])
                words += mine
                counts.append(len(mine))
                row += 1
            places = np.fromiter(map(lattices.index.__getitem__, words), np.int64, len(words))
            if lattices.index.new:
                lattices.add(lattices.index.new)
                lattices.index.new = []
            yield from slice_rows(batch, first, bodies, docs[first:row], places, np.array(counts, np.int64), lattices, k, seed, digest, decode)


def slice_rows(batch, first, bodies, docs, words, counts, lattices, k, seed, digest, decode):
    keys = (np.array([d or 0 for d in docs], np.int64).view(U) * U(2654435761) + U(seed)) if docs else np.zeros(0, U)
    searched, thresholds = top_k(lattices, keys, words, counts, k)
    everyone = [f for found in searched for f in found]
    edges = np.concatenate([f.edges for f in everyone]) if everyone else np.zeros(0, np.int64)
    ids, sizes = lattices.ids_of(edges, np.array([len(f.edges) for f in everyone], np.int64))
    spelt, ends = lattices.pieces.spelled(ids, sizes)
    rows, out, n = [], {name: [] for name in OUT.names}, 0
    for i, (body, found, kappa) in enumerate(zip(bodies, searched, thresholds, strict=True)):
        own = np.frombuffer(body.encode(), np.uint8)
        for rank, f in enumerate(found):
            rows.append(first + i)
            out["rank"].append(rank + 1)
            out["log_prob"].append(f.log_p)
            out["perturbed"].append(f.value)
            out["inclusion"].append(1.0 if kappa == -inf else -expm1(-exp(min(700.0, f.log_p - kappa))))
            out["decodes"].append(np.array_equal(spelt[ends[n - 1] if n else 0 : ends[n]], own))
            n += 1
    carried = [n for n in batch.schema.names if n not in ("body", "doc")]
    columns, names = [batch.column(n).take(pa.array(rows, pa.int64())) for n in carried], [*carried, "ids"]
    upto = np.append(0, np.cumsum(sizes)).astype(np.int32)
    columns.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(ids)).cast(OUT.field("ids").type))
    if digest:
        raw = memoryview(np.ascontiguousarray(ids.astype("<i4", copy=False))).cast("B")
        hashes = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        columns += [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())]
        names += ["n_pieces", "ids_sha256"]
    plain = ("rank", "log_prob", "perturbed", "inclusion", "decodes")
    columns += [pa.array(out[n], OUT.field(n).type) for n in plain]
    names += plain
    if decode:
        columns.append(pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(spelt)))
        names.append("decoded")
    yield pa.RecordBatch.from_arrays(columns, names)


def segmentations(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",), digest: bool = False, decode: bool = False) -> DataFrame:
    """A row for each text and rank: ``keep`` columns, ids, log probability, perturbed value, inclusion score.

    With ``digest`` also the number of ids and their digest, with ``decode`` the text that they stand for.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)), quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    ids = "ids array<int>, n_pieces long, ids_sha256 string" if digest else "ids array<int>"
    text = ", decoded string" if decode else ""
    out = rows.mapInArrow(lambda it: sampled(it, model.value, k, seed, digest, decode), f"{kinds}{ids}, rank int, log_prob double, perturbed double, inclusion double, decodes boolean{text}")
    own = [c for c in out.columns if c not in names]
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *own)


def decoded(df: DataFrame, model_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with the text that its ids stand for; null ids give null."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in batches:
            values = [None if ids is None else pieces.decoded(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(texts, f"{schema}, `{name}` string")


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    """The sampled ids of every document, their digest, and the texts that they decode to."""
    return segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digest=True, decode=True)
