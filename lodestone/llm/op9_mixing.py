"""Language-model scores by logistic context mixing of bit predictors.

A text, A-Z lower-cased, is a sequence of words, gaps and an end. The end, an
escape and the most frequent words have a Huffman code of their training counts.
Each bit of it is predicted by how often its node is left by a 1 in all training
texts, and from two hashed contexts: the word before, and the two words before.
A hashed slot holds how often it was left by a 0 and by a 1; up to SMALL times
it keeps both counts, beyond that their odds. The predictors' log odds are mixed
in the logistic domain by weights of a gate, which is how much is known of both
contexts and how deep in the code the bit is. Weights begin as fitted on all bits of all
training rows (with each bit's own count left out), and are learned online while a text
is read, every CHUNK bits, later every LATER bits; the mix is refined by an adaptive scale and offset.

A word without a code is the escape and then its share of all training words
without a code, less a discount; the counts of all words, however many, stay
distributed and are joined to the words asked for. What the discount leaves is
for words never seen, which are spelled: their bytes' bits, in a fixed prefix
code, are predicted from the last two bytes, the last three and the last five,
which all different training words teach, and are mixed alike. Gaps are predicted from
the byte before. A score is the log probability of all of it, so minus its log2
over the bytes is the text's bits per byte.

Scores do not depend on how texts are dealt to tasks and slabs. Texts over
LONG_TEXT bytes are read in pieces, from one to the next of which the words before
and the text's weights are carried. Words with a code are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, fold_of, lean, read
from .textkit import LOWER, U64, Slab, byte_strings, mix, pieces_of, slabs

#: log2 of the slots of a hashed context: eight for each training word, within these bounds (memory of a worker).
MIN_SLOT_BITS, MAX_SLOT_BITS = 16, 24
#: Bytes before that spelled bits are predicted from.
SPELL_REACH, SPELL_SLOT_BITS = (2, 3, 5), 20
PART_BITS = 16
SLAB_BYTES, LONG_TEXT = 3 << 17, 2 << 20
#: So many of the most frequent words have a code and go to all executors (bounded); the others stay distributed.
HEAVY_WORDS = 1 << 17
MIN_COUNT = 2
#: Partitions that one counting task reads: each task sends whole tables.
PARTS_A_TASK = 4
#: Steps of static log odds that the first weights are fitted with, and rounds of it.
LEVELS, FIT_ROUNDS = 16, 3
#: Bits of a text after which its weights are brought up to date: CHUNK among its FIRST, then LATER; and the rates of learning.
CHUNK, FIRST, LATER = 32, 1024, 128
RATE, RATE_SCALE, RATE_OFFSET = 0.02, 0.002, 0.002
SMALL, MAX_ODDS, PSEUDO = 12, 9.0, 0.4
N_SMALL = (SMALL + 1) * (SMALL + 2) // 2
ODDS_STEP = 16 / (255 - N_SMALL)
#: Leading bits by which hashes of words are looked up.
LEADING = 20
#: Gates, and the first bits of a code that have gates of their own.
GATES, DEEP = 32, 4
#: Bits of a code whose nodes' counts stand side by side, as they are looked up together.
RUN = 4
#: Texts' bits that are looked up at once.
BITS_AT_ONCE = 1 << 15
#: Bytes from common to rare: the prefix code's order, not the corpus' own, so that no pass is needed for it.
COMMON = b" etaoinrshld\xc3cumf\n.,pgwybv\xa9\xa8\xff-k'0123456789xjqz!?:;/()*$%&#|@_+=<>\""


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """A byte for each pair of counts: both of them if they are small, their log odds else."""
    n = n0 + n1
    few = np.minimum(n, SMALL).astype(np.int64)
    large = np.clip(np.rint((np.log((n1 + 0.5) / (n0 + 0.5)) + 8) / ODDS_STEP), 0, 255 - N_SMALL)
    return np.where(n <= SMALL, few * (few + 1) // 2 + np.minimum(n1, few), N_SMALL + large).astype(np.uint8)


def _state_tables():
    """For each state its log odds, how much is known (0 to 3), and the state without one 0, without one 1."""
    odds, known = np.zeros(256, np.float32), np.full(256, 3, np.uint8)
    less = np.tile(np.arange(256, dtype=np.uint8), (2, 1))
    odds[N_SMALL:] = np.arange(256 - N_SMALL) * ODDS_STEP - 8
    for n in range(SMALL + 1):
        for n1 in range(n + 1):
            at = n * (n + 1) // 2 + n1
            odds[at], known[at] = np.log((n1 + PSEUDO) / (n - n1 + PSEUDO)), min(n, 1) + (n > 2)
            if n1 < n:
                less[0, at] = (n - 1) * n // 2 + n1
            if n1:
                less[1, at] = (n - 1) * n // 2 + n1 - 1
    return odds, known, less


_ODDS, _KNOWN, _LESS = _state_tables()


def huffman_tree(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's parent and side, leaves first; each inner node's log odds of a 1."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(heap)
    parent, side, odds = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, np.uint8), np.zeros(n, np.float32)
    for made in range(n, 2 * n - 1):
        x, y = heapq.heappop(heap), heapq.heappop(heap)
        parent[[x[1], y[1]]] = made
        side[y[1]] = 1
        odds[made - n] = np.log(y[0] / x[0])
        heapq.heappush(heap, (x[0] + y[0], made))
    return parent, side, odds


def codes_of(parent: np.ndarray, side: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree's codes: where each begins (one more than there are leaves), their nodes and bits; each node's log odds of a 1."""
    n = len(odds)
    steps, at, live = [], np.arange(n), np.arange(n)
    while len(live):  # all leaves climb one node a turn
        up = parent[at[live]]
        live, up = live[up >= 0], up[up >= 0]
        steps.append((live, up - n, side[at[live]]))
        at[live] = up
    leaf, node, bit = (np.concatenate([x[k] for x in steps[::-1]]) for k in range(3))
    order = np.argsort(leaf, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))]).astype(np.int32), node[order].astype(np.int32), bit[order].astype(np.uint8), odds


def huffman(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return codes_of(*huffman_tree(weights))


def byte_code(common: bytes = COMMON):
    """The prefix code of bytes, for weights that fall with rank."""
    rank = {b: k for k, b in enumerate(dict.fromkeys(common))}
    return huffman([1 / (3 + rank[b]) ** 1.2 if b in rank else 1e-5 for b in range(256)])


def marks(code) -> np.ndarray:
    """Of each bit of all codes the bit itself (lowest), above it its node's place (1 to 15) among the nodes of a run of RUN bits, and whether it is beyond the code's first DEEP."""
    at, _, sides, _ = code
    size, out = np.diff(at), sides.copy()
    for k in range(int(size.max(initial=0))):
        here = at[:-1][size > k] + k
        out[here] |= (out[here - 1] & 31) << 1 if k % RUN else 2
        if k >= DEEP:
            out[here] |= 32
    return out


def word_table(words: pa.Array, counts: np.ndarray, ends: int, rare: int):
    """The words with a code: (sorted hashes, their leaves, where each leading part begins, most of one, each code bit's log odds of a 1, marks, code); leaf 0 is the end, 1 the escape."""
    return table_of(*word_tree(word_hashes(words), counts, ends, rare))


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    slab = next(slabs(pa.array([b" ".join(words.to_pylist())], pa.binary()).cast(pa.large_binary()), 1 << 40))
    return slab.hashes(*slab.words()[:2])


def word_tree(hashes: np.ndarray, counts: np.ndarray, ends: int, rare: int):
    """What a word table is made of: sorted hashes, their order, and the code's tree."""
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.int32), huffman_tree([ends + 1.0, rare + 1.0, *counts.astype(float).tolist()])


class Packed:
    """A word table that is sent as what it is made of, a tenth of its size."""

    def __init__(self, *parts):
        self.parts = parts

    def __reduce__(self):
        return table_of, self.parts


def table_of(hashes: np.ndarray, order: np.ndarray, tree):
    first = np.searchsorted(hashes, np.arange(1 << LEADING, dtype=np.uint64) << U64(64 - LEADING)).astype(np.int32)
    most = int(np.diff(np.append(first, len(hashes))).max(initial=0))
    code = codes_of(*tree)
    return np.append(hashes, U64(0)), np.append(order + 2, 1).astype(np.int32), first, most, code[3][code[1]], marks(code), code


def leaves(table, h: np.ndarray) -> np.ndarray:
    """The leaf of each hash; 1 for words without a code."""
    hashes, leaf, first, most, *_ = table
    out, left = np.ones(len(h), np.int32), np.arange(len(h))
    at = first[(h >> U64(64 - LEADING)).astype(np.int64)]
    for _ in range(most):
        found = hashes[at] == h[left]
        out[left[found]] = leaf[at[found]]
        more = ~found & (hashes[at] < h[left]) & (at < len(hashes) - 1)
        left, at = left[more], at[more] + 1
    return out


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given sizes: the run of each item, and its place in it."""
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return owner, np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)


def _paths(first: np.ndarray, size: np.ndarray):
    """Of codes that begin at ``first`` and are ``size`` bits long, one after the other: where each bit stands in the code table, each code's first bit, and of runs of RUN bits their code, first bit and size."""
    begun = np.cumsum(size, dtype=np.int64) - size
    path = np.repeat(first - begun, size)
    path += np.arange(len(path))
    code, k = _spread(-(-size // RUN))
    return path, begun, (code, begun[code] + RUN * k, np.minimum(RUN, size[code] - RUN * k))


def _slots(key: np.ndarray, node: np.ndarray, place: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Slots of (context, node). The nodes of a run, whose context and first node (both 32 bits) and size are given, stand in 16 neighbouring slots."""
    slot = node * np.uint32(0x9E3779B1)
    slot += key
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(0x85EBCA6B)
    out = np.repeat(slot >> np.uint32(32 - bits), size)
    out ^= place
    return out.view(np.int32)


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> U64(32)).astype(np.uint32)


def word_bits(slab: Slab, words, slot_bits: int, before: np.ndarray, whole: bool = True):
    """All bits of a slab's words and ends: (bit, [static log odds], slots of each context, is it beyond the code's first DEEP, first bit of each text), tokens, the last two words.

    ``before`` has the two words before the slab's first; an unfinished text (not ``whole``) has no end.
    """
    begin, end, doc = slab.words()
    h = slab.hashes(begin, end)
    leaf = leaves(words, h)
    tokens = (begin, end, doc, h, leaf)
    stop = np.searchsorted(doc, np.arange(slab.n if whole else slab.n - 1), "right")  # each text's end comes after its words
    token_leaf, token_doc, token_h = np.insert(leaf, stop, 0), np.insert(doc, stop, np.arange(len(stop))), np.insert(h, stop, 0)
    last = np.zeros((2, len(token_h)), np.uint64)
    for k in (1, 2):
        same = token_doc[k:] == token_doc[:-k]
        last[k - 1, k:][same] = token_h[:-k][same]
        last[k - 1, :k] = before[2 - k :][: len(token_h)]
    at, nodes, *_ = words[-1]
    size = np.diff(at)[token_leaf]
    path, begun, (token, head, run) = _paths(at[token_leaf], size)
    mark, top = words[-2].take(path, mode="clip"), nodes[path[head]].view(np.uint32)
    place = mark >> 1 & 15
    pair = mix(last[0] * U64(0x9E3779B97F4A7C15) + last[1])
    slots = [_slots(_short(x)[token], top, place, run, slot_bits) for x in (last[0], pair)]
    first_bit = np.append(begun, len(path))[np.searchsorted(token_doc, np.arange(slab.n + 1))]
    return (mark & 1, [words[-3].take(path, mode="clip")], slots, mark >> 5, first_bit), tokens, np.concatenate([before, h])[-2:]


def spelled_bits(words: pa.Array, code, slot_bits: int = SPELL_SLOT_BITS):
    """All bits of words' bytes, a space after each: as word_bits, without static log odds."""
    slab = next(slabs(words.cast(pa.large_binary()), 1 << 40), None)
    at, nodes, *_ = code
    if slab is None:
        return np.zeros(0, np.uint8), [], [np.zeros(0, np.int32)] * 3, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    length = np.diff(slab.offsets) + 1
    owner, place = _spread(length)
    where = slab.offsets[:-1][owner] + place
    inside = place < length[owner] - 1
    byte = np.where(inside, np.append(slab.data, 0)[np.minimum(where, len(slab.data))], 0x20)
    size = np.diff(at)[byte]
    path, begun, (ref, head, run) = _paths(at[byte], size)
    mark, top = marks(code).take(path, mode="clip"), nodes[path[head]].view(np.uint32)
    place, b = mark >> 1 & 15, slab.offsets[:-1][owner]
    slots = [_slots(_short(slab.hashes(np.maximum(b, where - reach), where))[ref], top, place, run, slot_bits) for reach in SPELL_REACH]
    return mark & 1, [], slots, mark >> 5, np.append(begun, len(path))[np.append(np.cumsum(length) - length, len(byte))]


def gaps(slab: Slab, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte before, kind, bytes) of the gaps between ``words``; kind 0 is a space, 1 a newline, 2 anything else."""
    begin, end, doc = words
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    size = begin[inner + 1] - end[inner]
    what = slab.data[end[inner]] if len(inner) else np.zeros(0, np.uint8)
    kind = np.where((size == 1) & (what == 0x20), 0, np.where((size == 1) & (what == 0x0A), 1, 2))
    return doc[inner], slab.data[end[inner] - 1] if len(inner) else what, kind, size


def fewer(rows: DataFrame) -> DataFrame:
    """The rows in fewer tasks, of PARTS_A_TASK partitions each, but no fewer than are run at once."""
    parts = rows.rdd.getNumPartitions()
    return rows.coalesce(max(1, min(parts, max(rows.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS_A_TASK)))))


def counted_states(rows: DataFrame, events, n_kinds: int, slot_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each context's states over all rows, and sums of 768 numbers.

    ``events(batches, add)`` calls add(bit, slots) and returns a task's own part
    of the 768. A task sends what it has counted in parts of 2**PART_BITS
    counters, which are added on executors; one byte a slot reaches the driver.
    """
    part = min(1 << PART_BITS, 2 << slot_bits)

    def count(batches):
        tables, waiting = [np.zeros(2 << slot_bits, np.uint8) for _ in range(n_kinds)], [[] for _ in range(n_kinds)]
        over = [[np.zeros((2, 0), np.int64)] for _ in range(n_kinds)]  # counters that came over 255: they start again at 0

        def flush():
            for table, some, more in zip(tables, waiting, over, strict=True):
                if some:
                    seen = np.sort(np.concatenate(some))
                    new = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
                    at = seen[new]
                    times = np.diff(np.append(new, len(seen))) + table[at]
                    full = times > 255
                    more.append(np.stack([at[full], times[full]]))
                    times[full] = 0
                    table[at] = times
                some.clear()

        def add(bit, slots):
            for some, slot in zip(waiting, slots, strict=True):
                some.append(slot << 1 | bit)
            if sum(map(len, waiting[0])) > 1_000_000:
                flush()

        rest = events(batches, add)
        flush()
        for k, table in enumerate(tables):
            large = np.concatenate(over[k], 1)
            large = large[:, np.argsort(large[0], kind="stable")]
            edges = np.searchsorted(large[0], np.arange(0, len(table) + 1, part))
            for j in range(len(table) // part):
                piece, (at, times) = table[j * part : (j + 1) * part], large[:, edges[j] : edges[j + 1]]
                seen = np.flatnonzero(piece)
                if len(seen) + len(at):
                    dense = 2 * len(seen) > part
                    high = np.flatnonzero(piece > 15)
                    if dense and 12 * len(high) < part:  # two counters a byte; what is above 15 goes to the list
                        at, times = np.concatenate([at, high + j * part]), np.concatenate([times, piece[high] - (piece[high] & 15)])
                        piece = piece & 15
                        piece = piece[::2] | piece[1::2] << 4
                    columns = [(seen[:0] if dense else seen).astype("<u2"), piece if dense else piece[seen], (at - j * part).astype("<u2"), times.astype("<u4")]
                    yield pa.RecordBatch.from_arrays([pa.array([k << 16 | j], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names)
        yield pa.RecordBatch.from_arrays([pa.array([n_kinds << 16], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", b"", np.arange(768, dtype="<u2").tobytes(), np.asarray(rest, "<u4").tobytes()))], names)

    def gather(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, bins, counts, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into, some = sums.setdefault(key, np.zeros(part)), np.frombuffer(counts, np.uint8)
                if not bins and 2 * len(some) == part and key >> 16 < n_kinds:
                    some = np.stack([some & 15, some >> 4], 1).ravel()
                into[np.frombuffer(bins, "<u2") if bins else slice(len(some))] += some
                np.add.at(into, np.frombuffer(at, "<u2"), np.frombuffer(times, "<u4"))
        for key, total in sums.items():
            out = total[:768].astype("<f8") if key >> 16 == n_kinds else states(total[::2], total[1::2])
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "states"])

    names = ["part", "bins", "counts", "at", "times"]
    partial = fewer(rows).mapInArrow(lean(count), "part int, bins binary, counts binary, at binary, times binary")
    tables, rest = [np.zeros(1 << slot_bits, np.uint8) for _ in range(n_kinds)], np.zeros(768)
    found = partial.repartition("part").mapInArrow(lean(gather), "part int, states binary").toArrow()  # at most the tables' fixed size
    for key, raw in zip(found["part"].to_pylist(), found["states"], strict=True):
        k, j = key >> 16, key & 0xFFFF
        raw = raw.as_buffer()
        if k == n_kinds:
            rest = np.frombuffer(raw, "<f8")
        else:
            tables[k][j * part // 2 : (j + 1) * part // 2] = np.frombuffer(raw, np.uint8)
    return tables, rest


def inputs(bits, tables: list[np.ndarray], own: bool = False):
    """The three predictors' log odds of each bit, and its gate; with ``own`` the bit itself is left out of its slots' counts."""
    bit, static, slots, deep, _ = bits
    found = [t.take(s, mode="clip") for t, s in zip(tables, slots, strict=True)]
    if own:
        found = [_LESS[bit, f] for f in found]
    gate = _KNOWN.take(found[-1]) << 2 | _KNOWN.take(found[-2]) | deep << 4
    return [*static, *(_ODDS.take(f) for f in found)], gate


def fit_sums(xs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each gate the gradient (4) and the curvature (4 x 4) of the log likelihood of bits that are met so many ``times``, and last the log likelihood."""
    xs = [*xs, np.ones(len(gate), np.float32)]
    y = np.clip(sum(weights[gate, k] * x for k, x in enumerate(xs)), -MAX_ODDS, MAX_ODDS)
    p = 1 / (1 + np.exp(-y))
    e = bit - p
    v = p * (1 - p) * times
    out = np.zeros((GATES, 21))
    for k, x in enumerate(xs):
        out[:, k] = np.bincount(gate, e * times * x, GATES)
        for j, z in enumerate(xs[: k + 1]):
            out[:, 4 + 4 * k + j] = out[:, 4 + 4 * j + k] = np.bincount(gate, v * x * z, GATES)
    out[:, 20] = np.bincount(gate, np.log(np.maximum(1 - np.abs(e), 1e-9)) * times, GATES)
    return out


def level_of(static: np.ndarray) -> np.ndarray:
    """Static log odds in steps of 1/16; all from the last step on are one."""
    return np.minimum(static * np.float32(16), np.float32(LEVELS - 1)).astype(np.int32)


def level_odds(code, weights: np.ndarray) -> np.ndarray:
    """The mean static log odds of a level's bits, by the weights that the code is made of."""
    at, nodes, _, odds = code
    times = np.bincount(nodes, np.repeat(weights, np.diff(at)), len(odds))
    level = level_of(odds)
    return np.bincount(level, times * odds, LEVELS) / np.maximum(np.bincount(level, times, LEVELS), 1e-9)


def counted_cells(rows: DataFrame, events, n_static: int) -> pa.Table:
    """(cell, n): how often all rows' bits are met with each of the inputs that they are predicted from. ``events(batches)`` gives bits and tables, by turns.

    A cell is ``seen`` with the bit's own count left out, above it the level of its static log odds.
    A task sends each cell once; the driver gets those that occur.
    """

    def run(batches):
        some, waiting, size = (np.zeros(0, np.int32), np.zeros(0, np.int64)), [], 0
        dense = np.zeros(LEVELS << 18, np.uint32) if n_static else None

        def merged():
            cell = np.sort(np.concatenate(waiting)) if waiting else np.zeros(0, np.int32)
            new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            both, times = np.concatenate([some[0], cell[new]]), np.concatenate([some[1], np.diff(np.append(new, len(cell)))])
            order = np.argsort(both, kind="stable")
            both, times = both[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else new
            return both[first], np.add.reduceat(times, first) if len(first) else times

        for bits, tables in events(batches):
            cell = seen(bits, tables, own=True)
            if n_static:
                cell |= level_of(bits[1][0]) << 18
                np.add.at(dense, cell, np.uint32(1))
                continue
            waiting.append(cell)
            size += len(cell)
            if size > 1 << 21:
                some, size = merged(), 0
                waiting.clear()
        cell, times = (np.flatnonzero(dense), dense[dense > 0]) if n_static else merged()
        for lo in range(0, len(cell), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)].astype(t)) for x, t in ((cell, np.int32), (times, np.int64))], ["cell", "n"])

    return fewer(rows).mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()


def fitted(cells: pa.Table, levels: np.ndarray | None, start: tuple[float, ...], rounds: int = FIT_ROUNDS) -> np.ndarray:
    """A gate's weights by Newton steps over all of ``cells``; ``levels`` are their static log odds (or None). Of all rounds the best stays."""
    begin = np.tile(np.array([*start, 0.0]), (GATES, 1))
    weights, best = begin.copy(), (-np.inf, begin)
    cells = cells.sort_by("cell")
    n_contexts = 3 if levels is None else 2
    for turn in range(rounds):
        total = np.zeros((GATES, 21))
        for lo in range(0, len(cells), 1 << 16):
            cell, n = (cells[c].slice(lo, 1 << 16).to_numpy() for c in ("cell", "n"))
            found = [cell >> 8 * k & 255 for k in range(n_contexts)]
            above = cell >> 8 * n_contexts
            gate = _KNOWN[found[-1]] << 2 | _KNOWN[found[-2]] | (above & 1) << 4
            xs = [*([levels[above >> 2]] if levels is not None else []), *(_ODDS[f] for f in found)]
            total += fit_sums(xs, gate, above >> 1 & 1, n, weights)
        if total[:, 20].sum() > best[0]:
            best = (total[:, 20].sum(), weights)
        if turn == rounds - 1:
            break
        ridge = 20.0
        curve = total[:, 4:20].reshape(GATES, 4, 4) + ridge * np.eye(4)
        slope = total[:, :4] - ridge * (weights - begin)
        weights = np.clip(weights + np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -3, 3)
    return best[1].astype(np.float32)


class State:
    """What each text has learned so far: what it adds to the weights, its scale and offset."""

    def __init__(self, n: int):
        self.more = np.zeros((4, n), np.float32)
        self.scale = np.ones(n, np.float32)


def seen(bits, tables: list[np.ndarray], own: bool = False) -> np.ndarray:
    """What each bit is predicted from but its static log odds, in one number: the contexts' states, a byte each from the lowest on, whether it is deep, and the bit itself. ``own`` as in inputs."""
    bit, _, slots, deep, _ = bits
    found = [t.take(s, mode="clip") for t, s in zip(tables, slots, strict=True)]
    if own:
        found = [_LESS.ravel().take(bit.astype(np.int32) << 8 | f, mode="clip") for f in found]
    out = bit << 1
    out = (out | deep).astype(np.int32)
    for f in found[::-1]:
        out <<= 8
        out |= f
    return out


def starter(n_static: int, start: np.ndarray):
    """A function of static log odds and ``seen`` (without the bit): the predictors' log odds, and their mix by the weights that every text begins with."""
    state, by = np.arange(256), np.ascontiguousarray(start.T)
    if not n_static:

        def mixed(_, code):
            found = [code >> 8 * k & 255 for k in range(3)]
            gate = _KNOWN.take(found[2]) << 2 | _KNOWN.take(found[1]) | (code >> 24).astype(np.uint8) << 4
            xs = [_ODDS.take(f) for f in found]
            return xs, by[3].take(gate) + sum(by[k].take(gate) * x for k, x in enumerate(xs))

        return mixed
    # all pairs of states, shallow and deep, are looked up at once
    gate = (_KNOWN[state][:, None].astype(int) << 2 | _KNOWN[state]) + np.array([0, 16])[:, None, None]
    pairs = (by[3][gate] + by[2][gate] * _ODDS[:, None] + by[1][gate] * _ODDS).astype(np.float32).ravel()
    weight, one, two = by[0][gate].astype(np.float32).ravel(), np.tile(_ODDS, 512), np.tile(np.repeat(_ODDS, 256), 2)

    def mixed(static, code):
        given = weight.take(code, mode="clip")
        given *= static
        given += pairs.take(code, mode="clip")
        return [static, one.take(code, mode="clip"), two.take(code, mode="clip")], given

    return mixed


def mixed_log_prob(bits, tables: list[np.ndarray], start: np.ndarray, state: State | None = None) -> np.ndarray:
    """Natural log probability of each text's bits. All texts advance together by CHUNK bits, later LATER, the longest first; ``state`` is learned on."""
    static, first_bit = bits[1], bits[-1]
    size = np.diff(first_bit)
    n = len(size)
    state = state or State(n)
    out = np.zeros(n)
    if not len(bits[0]):
        return out
    code, mixed = seen(bits, tables), starter(len(static), start)
    side = 8 * len(tables) + 1
    by = np.argsort(-size, kind="stable")
    size, first, f4 = size[by], first_bit[:-1][by], np.float32
    more, scale, most, half = state.more[:, by], state.scale[by], f4(MAX_ODDS / 2), f4(0.5)
    lo = 0
    while lo < size[0]:
        n = int(np.searchsorted(-size, -lo))  # texts that go on beyond bit lo
        chunk = CHUNK if lo < FIRST else LATER
        hi = lo + chunk * max(1, BITS_AT_ONCE // (n * chunk))
        hi = min(hi, FIRST) if lo < FIRST else hi
        hi = min(hi, lo + -(-int(size[0] - lo) // chunk) * chunk)
        place = np.arange(lo, hi)[:, None]
        at = place + first[:n]
        now = code.take(at, mode="clip")
        live = None if size[n - 1] >= hi else (place < size[:n]).astype(f4)
        bit = (now >> side).astype(f4)
        bit -= half
        xs, given = mixed(static[0].take(at, mode="clip") if static else None, now & (1 << side) - 1)
        prob = np.empty((hi - lo, n), f4)
        for k in range(0, hi - lo, chunk):
            to = slice(k, k + chunk)
            S = [x[to] for x in xs]
            x = given[to]
            x += more[3, :n]
            for w, s in zip(more, S, strict=False):
                x += s * w[:n]
            y = x * (scale[:n] * half)
            np.minimum(y, most, out=y)
            np.maximum(y, -most, out=y)
            np.tanh(y, out=y)  # the logistic function is half of it and a half
            y *= half
            e = np.subtract(bit[to], y, out=y)
            if live is not None:
                e *= live[to]
            np.abs(e, out=prob[to])
            x *= e
            for w, s in zip(more, S, strict=False):
                s *= e
                w[:n] += f4(RATE) * s.sum(0)
            more[3, :n] += f4(RATE_OFFSET) * e.sum(0)
            scale[:n] += f4(RATE_SCALE) * x.sum(0)
        np.subtract(f4(1), prob, out=prob)
        out[by[:n]] += np.log(prob, out=prob).sum(0, dtype=np.float64)
        lo = hi
    state.more[:, by], state.scale[by] = more, scale
    return out


def gap_log_prob(slab: Slab, words, kinds: np.ndarray, begun: bool = False, whole: bool = True) -> np.ndarray:
    """Natural log probability of each text's gaps. A text begins and ends without one 99 times in 100; other bytes cost log 6 each, and their number a bit each."""
    doc, byte, kind, size = gaps(slab, words)
    out = np.bincount(doc, kinds[byte, kind] - np.where(kind == 2, size * np.log(12.0), 0.0), slab.n).astype(np.float64)
    begin, end, word_doc = words
    first, last = slab.offsets[1:].copy(), slab.offsets[1:].copy()
    have = np.unique(word_doc)
    first[have], last[have] = begin[np.searchsorted(word_doc, have)], end[np.searchsorted(word_doc, have, "right") - 1]
    for size, at_edge in ((first - slab.offsets[:-1], not begun), (slab.offsets[1:] - last, whole)):
        out += np.where(size > 0, np.log(0.01) - size * np.log(12.0), np.log(0.99) if at_edge else 0.0)
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c) over all rows, A-Z lower-cased; each slab is counted before the JVM adds up."""

    def run(batches):
        for batch in batches:
            for slab, *_ in pieces_of(batch.column(0), 2 * SLAB_BYTES, LONG_TEXT):
                begin, end, _ = slab.words()
                if len(begin):
                    h = slab.hashes(begin, end)
                    order = np.argsort(h)
                    new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
                    one = order[new]
                    yield pa.RecordBatch.from_arrays([byte_strings(LOWER[slab.data], begin[one], end[one]), pa.array(np.diff(np.append(new, len(h))))], ["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def slot_bits_for(n_words: int) -> int:
    return min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, int(8 * n_words).bit_length()))


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The base is an add-0.1 unigram of ``training``'s words and text ends; score
    is the mixing model's log10 probability of the whole text. Null text is
    empty: its end is its only token. Repeated rows give repeated results, and
    equal texts equal scores; words of equal counts go to the codes in the order
    of their bytes. An empty ``docs`` gives an empty result; with an empty
    ``training`` all counts are 0 and every word is spelled. Texts of any
    length are read in pieces of LONG_TEXT bytes. Other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    slim = training.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    counts = cut(word_counts(slim))
    top = counts.where(F.col("c") >= MIN_COUNT).orderBy(F.desc("c"), "word").limit(heavy_words).toArrow()  # at most heavy_words rows
    heavy = top["c"].to_numpy()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = training.count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    floor = float(np.log10(n + 0.1 * (v + 1)))
    rare, rare_words = sums["n"] - int(heavy.sum()), sums["v"] - len(heavy)
    discount = min(0.95, max(0.05, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    tree = word_tree(word_hashes(top["word"].combine_chunks()), heavy, ends, rare)
    base_of = np.concatenate([[np.log10(ends + 0.1) - floor, 0.0], np.log10(heavy + 0.1) - floor])
    slot_bits, spelling = slot_bits_for(n), byte_code()
    codes = context.broadcast(Packed(*tree))
    none = np.zeros(2, np.uint64)

    def text_events(batches, add):
        between = np.zeros(768, np.int64)
        for batch in batches:
            before = none
            for slab, begun, whole in pieces_of(batch.column(0), SLAB_BYTES, LONG_TEXT):
                bits, tokens, before = word_bits(slab, codes.value, slot_bits, before if begun else none, whole)
                add(bits[0], bits[2])
                _, byte, kind, _ = gaps(slab, tokens[:3])
                between += np.bincount(byte.astype(np.int64) * 3 + kind, minlength=768)
        return between

    def word_events(batches, add):
        for batch in batches:
            for lo in range(0, len(batch), 50_000):
                bits = spelled_bits(batch.column(0).slice(lo, 50_000), spelling)
                add(bits[0], bits[2])
        return np.zeros(768)

    tables, between = counted_states(slim.select("text"), text_events, 2, slot_bits)
    spell_tables, _ = counted_states(counts.select("word"), word_events, 3, SPELL_SLOT_BITS)
    between = between.reshape(256, 3) + 0.5
    kinds = np.log(between / between.sum(1, keepdims=True))
    model = context.broadcast((tables, spell_tables, kinds))

    def text_bits(batches):
        for batch in batches:
            before = none
            for slab, begun, whole in pieces_of(batch.column(0), SLAB_BYTES, LONG_TEXT):
                bits, _, before = word_bits(slab, codes.value, slot_bits, before if begun else none, whole)
                yield bits, model.value[0]

    def once_bits(batches):
        for batch in batches:
            for lo in range(0, len(batch), 10_000):
                yield spelled_bits(batch.column(0).slice(lo, 10_000), spelling), model.value[1]

    levels = level_odds(codes_of(*tree[-1]), np.array([ends + 1.0, rare + 1.0, *heavy.tolist()]))
    start = fitted(counted_cells(slim.select("text"), text_bits, 1), levels, (1.0, 0.1, 0.1))
    spell_start = fitted(counted_cells(counts.where("c = 1").select("word"), once_bits, 0), None, (0.2, 0.4, 0.4))

    def run(batches):
        words, (tables, _, kinds) = codes.value, model.value
        names = ["row", "_id", "word", "k", "n_tokens", "n_known", "base_score", "score"]
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(pc.binary_length(pc.fill_null(batch.column(2), ""))))  # texts of like length advance together
            before, state = none, None
            for slab, begun, whole in pieces_of(batch.column(2), SLAB_BYTES, LONG_TEXT):
                if not begun:
                    before, state = none, State(slab.n)
                bits, (begin, end, doc, h, leaf), before = word_bits(slab, words, slot_bits, before, whole)
                score = mixed_log_prob(bits, tables, start, state) + gap_log_prob(slab, (begin, end, doc), kinds, begun, whole)
                last = int(whole)
                tokens = np.bincount(doc, minlength=slab.n) + last
                known = np.bincount(doc[leaf > 1], minlength=slab.n) + (last if ends else 0)
                base = np.bincount(doc, base_of[leaf], slab.n) + last * base_of[0]
                rows, ids = batch.column(0).slice(slab.lo, slab.n), batch.column(1).slice(slab.lo, slab.n)
                no_word = pa.array([b" %d" % r for r in rows.to_pylist()], pa.binary())  # a space is in no word: these are dealt evenly and meet no count
                yield pa.RecordBatch.from_arrays([rows, ids, no_word, pa.array(np.zeros(slab.n, np.int64)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score / np.log(10))], names)
                odd = np.flatnonzero(leaf == 1)
                if len(odd):
                    tag = mix(h[odd] ^ mix(doc[odd].astype(np.uint64) + U64(1)))
                    order = np.argsort(tag)
                    new = np.flatnonzero(np.concatenate([[True], tag[order][1:] != tag[order][:-1]]))
                    one = odd[order[new]]
                    empty = [pa.nulls(len(one), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pc.take(rows, pa.array(doc[one])), pa.nulls(len(one), ids.type), byte_strings(LOWER[slab.data], begin[one], end[one]), pa.array(np.diff(np.append(new, len(odd)))), *empty], names)

    log_unknown = np.log(discount * max(rare_words, 1) / rare) if rare else 0.0

    def rare_scores(batches):
        for batch in batches:
            row, id_, word, k, c, *rest = batch.columns
            times = k.to_numpy().astype(np.float64)
            seen = pc.fill_null(c, 0).to_numpy()
            score = np.log(np.maximum(seen - discount, 1e-3) / max(rare, 1)) / np.log(10)
            lost = np.flatnonzero((seen == 0) & (times > 0))
            for lo in range(0, len(lost), 20_000):
                some = lost[lo : lo + 20_000]
                bits = spelled_bits(pc.take(word, pa.array(some)), spelling)
                score[some] = (mixed_log_prob(bits, model.value[1], spell_start) + log_unknown) / np.log(10)
            base = np.log10(seen + 0.1) - floor
            tokens, known, text_base, text_score = (pc.fill_null(x, 0).to_numpy() for x in rest)
            a_word = times > 0  # else a text's sums over its other words
            columns = [tokens, np.where(a_word, times * (seen > 0), known).astype(np.int64), np.where(a_word, times * base, text_base), np.where(a_word, times * score, text_score), ~a_word]
            yield pa.RecordBatch.from_arrays([row, id_, *map(pa.array, columns)], ["row", "_id", "n_tokens", "n_known", "base_score", "score", "whole"])

    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    parts = given.mapInArrow(lean(run), f"row long, _id {kind}, word binary, k long, n_tokens long, n_known long, base_score double, score double")
    parts = parts.join(counts, "word", "left").select("row", "_id", "word", "k", "c", "n_tokens", "n_known", "base_score", "score")
    parts = parts.mapInArrow(lean(rare_scores), f"row long, _id {kind}, n_tokens long, n_known long, base_score double, score double, whole boolean")
    total = parts.groupBy("row").agg(F.max(F.when(F.col("whole"), F.col("_id"))).alias(id_col), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return total.select(id_col, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = fold_of("doc_id", 10) == 0
    found = score_texts(docs, docs.where(~held))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_mixing": op9_mixing}
SQL: dict[str, str] = {}
