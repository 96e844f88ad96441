"""Repeated passages: paragraph MinHash banding, verified, clustered, and cut out.

Two kinds of paragraphs are used. Short ones are cut where the hash of a word
pair is the least within RADIUS words, so a passage is cut alike wherever it is
pasted; their whole word sequence is one band. Long ones are the \\n-split lines
of MIN_RUN words and more; their 5-word shingles are MinHashed in BANDS bands of
ROWS rows (recall 1 - (1 - 0.8**2)**8 = 0.9997 at similarity 0.8), colliding
lines are verified by exact Jaccard similarity, and components of the links are
clusters. Lines of a band are compared with three of it first; those that are not
linked to the band's hub are then compared with all others, block by block. Of each cluster the first paragraph (by id, then place) stays. Short
paragraphs at the edge of a repeated run are extended word by word as far as any
other copy agrees, spans up to GAP words apart are joined (an edited word), and what
spans MIN_RUN words or more goes.

Only 64-bit hashes are shuffled for all paragraphs. Fixed-size bitmaps of the
repeated hashes then let a second pass send the few paragraphs that matter, and
the words around them; the bitmaps may let others pass, and the joins that follow
are exact. Runs and their edges are found after the join with the repeated hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .session import cut, fresh_name, lean, read, release
from .textkit import U64, Slab, chained, mix, slabs

RADIUS = 4
BANDS, ROWS, SHINGLE, SIMILARITY = 8, 2, 5, 0.8
MIN_RUN, GAP, REACH = 40, 8, 24
#: Repeated runs of fewer words inside the short paragraphs' edges cannot belong to a passage of MIN_RUN words.
MIN_SEEN = 12
BITMAP_BITS = 27
#: Lines of a band that are compared at once with as many others.
BLOCK = 256
_SEEDS = np.random.default_rng(99).integers(1, 1 << 62, (2, BANDS * ROWS), dtype=np.uint64) * U64(2) + U64(1)


def short_paragraphs(slab: Slab):
    """(word hashes, text of each word, first word of each short paragraph, word after its last, content hash)."""
    begin, end, doc = slab.words()
    h = slab.hashes(begin, end, fold=False)
    n = len(h)
    if not n:
        return h, doc, np.zeros(0, np.int64), np.zeros(0, np.int64), h
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    pair = h.copy()
    pair[1:] = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    pair[new] = np.iinfo(np.uint64).max
    least = pair.copy()
    for k in range(1, RADIUS + 1):  # texts are at least that far apart only inside themselves
        for a, b in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            same = doc[a] == doc[b]
            np.minimum(least[a], np.where(same, pair[b], np.iinfo(np.uint64).max), out=least[a])
    first_of = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(first_of, np.diff(np.append(first_of, n)))
    left = np.repeat(np.diff(np.append(first_of, n)), np.diff(np.append(first_of, n))) - place
    start = new | (least == pair) & (place > RADIUS) & (left > RADIUS)
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * slab.up(n), dtype=np.uint64)])
    return h, doc, first, last, mix((sums[last] - sums[first]) * slab.down(n + 1)[first] + (last - first).astype(np.uint64))


def long_lines(slab: Slab, min_words: int = MIN_RUN):
    """(word hashes, text, first word, word after the last, content hash) of lines of ``min_words`` words and more."""
    begin, end, doc = slab.words()
    h = slab.hashes(begin, end, fold=False)
    lines = np.searchsorted(np.flatnonzero(slab.data == 10), begin)
    key = doc * (len(slab.data) + 1) + lines
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(h) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(h)) if len(h) else first
    keep = last - first >= min_words
    first, last = first[keep], last[keep]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * slab.up(len(h)), dtype=np.uint64)])
    return h, doc, first, last, mix((sums[last] - sums[first]) * slab.down(len(h) + 1)[first] + (last - first).astype(np.uint64))


def line_shingles(h: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Hashes of the 5-word shingles of all lines in turn, and where each line's begin (each has MIN_RUN words)."""
    whole, _ = chained(h, SHINGLE, np.zeros(len(h), np.int8))
    size = last - first - SHINGLE + 1
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return whole[at], np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def band_keys(shingles: np.ndarray, where: np.ndarray) -> np.ndarray:
    """BANDS keys for each line."""
    rows = [np.minimum.reduceat(mix(shingles * _SEEDS[0, k] + _SEEDS[1, k]), where) for k in range(BANDS * ROWS)]
    out = []
    for b in range(BANDS):
        key = np.full(len(where), b + 1, np.uint64)
        for r in rows[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * U64(0x9E3779B97F4A7C15) + r)
        out.append(key)
    return np.stack(out, 1)


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """2**bits bits, set for each hash; at most that many reach the driver, in pieces of 4 KB."""
    slot = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    found = hashes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("v"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in found.toLocalIterator():
        out[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(row["v"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & U64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _chains(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> pa.Array:
    """For each range of words, running 32-bit hashes from its start (step 1) or its end (step -1)."""
    size = hi - lo
    out, pos = np.zeros(int(size.sum()), np.int32), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    state = np.zeros(len(lo), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        word = h[lo[live] + k] if step > 0 else h[hi[live] - 1 - k]
        state[live] = mix(state[live] * U64(0x9E3779B97F4A7C15) + word)
        out[pos[live] + k] = (state[live] >> U64(32)).astype(np.uint32).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(pos, pa.int32()), pa.array(out))


def near_lines(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pairs, crowded): lines (id, h, b, e, bands), pairs of colliding contents (h, other), and (key, h, hub) of bands of over three contents.

    Pairs are those with a band's smallest and largest content hash, which are
    all pairs of up to three contents, and with its member in the largest bands,
    which an original has rather than its edited copies.
    """

    def run(batches):
        for batch in batches:
            for slab in slabs(batch.column(1)):
                h, doc, first, last, key = long_lines(slab)
                if len(first):
                    start = np.searchsorted(doc, doc[first])
                    bands = band_keys(*line_shingles(h, first, last))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * BANDS, pa.int32()), _signed(bands.ravel()))
                    yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(doc[first] + slab.lo)), _signed(key), pa.array(first - start), pa.array(last - start), flat], ["id", "h", "b", "e", "bands"])

    lines = cut(texts.mapInArrow(lean(run), "id long, h long, b long, e long, bands array<long>"))
    keys = lines.groupBy("h").agg(F.any_value("bands").alias("bands")).select("h", F.explode("bands").alias("key"))
    sizes = cut(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("lo < hi"))
    big = cut(keys.join(sizes.where("n > 3").select("key", "n"), "key"))
    weight = big.groupBy("h").agg(F.sum("n").alias("weight"))
    hubs = cut(big.join(weight, "h").groupBy("key").agg(F.max(F.struct("weight", "h")).h.alias("hub")))
    ends = sizes.join(hubs, "key", "left").select("key", F.array_compact(F.array("lo", "hi", "hub")).alias("ends"))
    pairs = keys.join(cut(ends), "key").select("h", F.explode("ends").alias("other")).where("h <> other")
    return lines, cut(pairs.select(F.least("h", "other").alias("h"), F.greatest("h", "other").alias("other")).distinct()), big.select("key", "h").join(hubs, "key")


def links_between(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets (distinct values each) of SIMILARITY and more that join all components they can."""
    size = np.array([len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(count), -1, np.int64)
    column[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(sets)), size), column[value]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, len(shared), 4096):
        part = slice(*np.searchsorted(column, [k, k + 4096]))
        held = np.zeros((len(sets), min(4096, len(shared) - k)), np.float32)
        held[row[part], column[part] - k] = 1
        both += held @ held.T
    near = both >= SIMILARITY * (size[:, None] + size[None, :] - both)
    _, root = np.unique(component, return_inverse=True)
    out = []
    for i, j in np.argwhere(np.triu(near & (root[:, None] != root[None, :]), 1)):
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            out.append((int(i), int(j)))
    return out


def block_links(crowded: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (h, other) of the members of each band (key, h, hub) that have none to its hub in ``near``, to all members, in blocks of about BLOCK by BLOCK."""
    known = near.select(F.col("h").alias("near_h"), F.col("other").alias("near_other"))
    linked = crowded.join(known, (F.least("h", "hub") == F.col("near_h")) & (F.greatest("h", "hub") == F.col("near_other")), "left")
    members = cut(linked.select("key", "h", (F.col("near_h").isNull() & (F.col("h") != F.col("hub"))).alias("loose"), F.when(F.col("near_h").isNull(), F.col("h")).otherwise(F.col("hub")).alias("component")))
    chunks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = cut(members.groupBy("key").agg(chunks(F.count_if("loose")).alias("loose_chunks"), chunks(F.count_if(~F.col("loose"))).alias("held_chunks")).where("loose_chunks > 0"))
    # loose lines have chunks 0, 1 ..., the others -1, -2 ...; two of the others are not compared
    own = F.pmod(F.xxhash64("h"), F.when(F.col("loose"), F.col("loose_chunks")).otherwise(F.col("held_chunks"))).cast("int")
    dealt = cut(members.join(counts, "key").withColumn("chunk", F.when(F.col("loose"), own).otherwise(-1 - own)))
    dealt = dealt.join(sets, "h").withColumn("with", F.explode(F.sequence(F.when(F.col("loose"), -F.col("held_chunks")).otherwise(0), F.col("loose_chunks") - 1)))
    dealt = dealt.select("key", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "h", "component", "s")

    def run(block: pa.Table) -> pa.Table:
        h = block.column("h").to_numpy()
        found = links_between([np.asarray(x.values) for x in block.column("s").combine_chunks()], block.column("component").to_numpy())
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"h": h[i], "other": h[j]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "h long, other long").distinct()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, source): the words [b, e) of each text that repeat an earlier passage.

    Only ids with spans are returned. ``source`` is the id that keeps the
    longest span's passage. Within one text a passage's first place stays.
    Rows with a null id or text have none. Repeated rows count as one text. Ids
    are cast to long; equal places are ordered by id. An empty table gives an
    empty result. All lines that share a band and are not linked through others
    are compared.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def hashes(batches):
        for batch in batches:
            for slab in slabs(batch.column(1)):
                key = short_paragraphs(slab)[4]
                yield pa.RecordBatch.from_arrays([_signed(key)], ["h"])

    counted = cut(texts.mapInArrow(lean(hashes), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    short_bits = bitmap(counted, "h")
    lines, pairs, crowded = near_lines(texts)
    line_bits = bitmap(pairs.select(F.explode(F.array("h", "other")).alias("h")), "h")
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((short_bits, line_bits))

    def seen(batches):
        short_bits, line_bits = held.value
        sent: set[int] = set()  # contents of long lines whose shingles this task has sent
        for batch in batches:
            for slab in slabs(batch.column(1)):
                h, doc, first, last, key = short_paragraphs(slab)
                if not len(first):
                    continue
                start, stop = np.searchsorted(doc, doc[first]), np.searchsorted(doc, doc[first], "right")
                hit = np.flatnonzero(in_bitmap(short_bits, key))
                if len(hit):
                    far = np.concatenate([[True], (first[hit[1:]] - last[hit[:-1]] > GAP) | (doc[first[hit[1:]]] != doc[first[hit[:-1]]])])
                    run = np.cumsum(far) - 1
                    head = np.flatnonzero(far)
                    tail = np.append(head[1:], len(hit)) - 1
                    enough = last[hit[tail]] - first[hit[head]] >= MIN_SEEN
                    hit, run, head, tail = hit[enough[run]], (np.cumsum(enough) - 1)[run[enough[run]]], hit[head[enough]], hit[tail[enough]]
                if len(hit):
                    s, t = start[head], stop[head]
                    lo, hi = np.maximum(s, first[head] - REACH), np.minimum(t, last[tail] + REACH)
                    ids = pc.take(batch.column(0), pa.array(doc[first[head]] + slab.lo))
                    where = np.concatenate([[0], np.cumsum(hi - lo)])
                    at = np.arange(where[-1]) + np.repeat(lo - where[:-1], hi - lo)
                    words = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array((h[at] >> U64(32)).astype(np.uint32).view(np.int32)))
                    of = pa.array(np.append(np.searchsorted(run, np.arange(len(head))), len(run)), pa.int32())
                    listed = [pa.ListArray.from_arrays(of, x) for x in (_signed(key[hit]), pa.array((first[hit] - s[run]).astype(np.int32)), pa.array((last[hit] - s[run]).astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(head), pa.int64()), pa.array(lo - s), pa.array(hi - s), *listed, words, pa.nulls(len(head), pa.list_(pa.int32()))], names)
                h, doc, first, last, key = long_lines(slab)
                hit = np.array([k for k in np.flatnonzero(in_bitmap(line_bits, key)) if not (int(key[k]) in sent or sent.add(int(key[k])))], np.int64)
                if len(hit):
                    shingles, where = line_shingles(h, first[hit], last[hit])
                    listed = pa.ListArray.from_arrays(pa.array(np.append(where, len(shingles)), pa.int32()), pa.array((shingles >> U64(32)).astype(np.uint32).view(np.int32)))
                    none, empty = pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(doc[first[hit]] + slab.lo)), _signed(key[hit]), none, none, pa.nulls(len(hit), pa.list_(pa.int64())), empty, empty, empty, listed], names)

    names = ["id", "h", "lo", "hi", "keys", "b", "e", "words", "shingles"]
    found = cut(texts.mapInArrow(lean(seen), "id long, h long, lo long, hi long, keys array<long>, b array<int>, e array<int>, words array<int>, shingles array<int>"))
    shingles = cut(found.where("shingles is not null").select("h", "shingles"))
    runs = _true_runs(found.where("shingles is null").drop("h", "shingles"), counted)
    held.destroy()  # found is written
    del found, counted
    release(docs.sparkSession)
    spans = _short_spans(runs).unionByName(_line_spans(lines, pairs, crowded, shingles))
    return _joined(spans)


def _true_runs(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, h, b, e, left, right): paragraphs whose hash is repeated, in runs of MIN_SEEN words and more; chains at the runs' edges.

    ``found`` has places (id, lo, hi) with their words and paragraphs (keys, b, e).
    """
    hit = F.struct("b", "e", "h")
    each = found.select("id", "lo", "hi", F.explode(F.arrays_zip("keys", "b", "e")).alias("x")).select("id", "lo", "hi", F.col("x.keys").alias("h"), F.col("x.b").cast("long").alias("b"), F.col("x.e").cast("long").alias("e"))
    known = each.join(repeated, "h").select("id", "lo", "hi", hit.alias("hit"), F.lit(None).cast("array<int>").alias("words"))
    spoken = found.select("id", "lo", "hi", F.lit(None).cast("struct<b:bigint,e:bigint,h:bigint>").alias("hit"), "words")
    placed = known.unionByName(spoken).groupBy("id", "lo", "hi").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.max("words").alias("words"))  # one text's own paragraphs

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, lo, hits, words = batch.columns
            place = np.repeat(np.arange(len(ids)), pc.list_value_length(hits).to_numpy())
            b, e, key = (x.to_numpy() for x in hits.flatten().flatten())
            h = words.flatten().to_numpy().astype(np.uint64)
            where = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
            far = np.concatenate([[True], (b[1:] - e[:-1] > GAP) | (place[1:] != place[:-1])])
            head = np.flatnonzero(far)
            tail = np.append(head[1:], len(b)) - 1
            enough = (e[tail] - b[head] >= MIN_SEEN)[np.cumsum(far) - 1]
            tails = np.concatenate([far[1:], [True]])
            far[1:] |= far[:-1]  # the second of a run too: another copy's run may begin with it
            tails[:-1] |= tails[1:]
            place, b, e, key, heads, tails = place[enough], b[enough], e[enough], key[enough], far[enough], tails[enough]
            shift = where[place] - lo.to_numpy()[place]
            first, last = b + shift, e + shift
            left = _chains(h, np.where(heads, np.maximum(where[place], first - REACH), first), first, -1)
            right = _chains(h, last, np.where(tails, np.minimum(where[place + 1], last + REACH), last), 1)
            yield pa.RecordBatch.from_arrays([pc.take(ids, pa.array(place)), pa.array(key), pa.array(b), pa.array(e), left, right], ["id", "h", "b", "e", "left", "right"])

    return cut(placed.where(F.size("hits") > 0).select("id", "lo", "hits", "words").mapInArrow(lean(run), "id long, h long, b long, e long, left array<int>, right array<int>"))


def _short_spans(found: DataFrame) -> DataFrame:
    """Spans of short paragraphs that are not their content's first; only rows at the edge of a run carry chains about."""
    place = F.struct("id", "b")
    copies = cut(found.groupBy("h").agg(F.min(place).alias("kept"), F.max(place).alias("latest")).where("kept <> latest").drop("latest"))
    edge = (F.size("left") > 0) | (F.size("right") > 0)
    later = (F.col("id") != F.col("kept.id")) | (F.col("b") != F.col("kept.b"))
    inner = found.where(~edge).select("h", "id", "b", "e").join(copies, "h").where(later).select("id", "b", "e", F.col("kept.id").alias("source"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("chain")) for k, c in enumerate(("left", "right"))]))
    sided = lambda df: df.where(edge).withColumn("x", sides).select(*[c for c in df.columns if c not in ("left", "right")], "x.*").where(F.size("chain") > 0)
    one = F.struct("id", "b", "chain")
    ends = cut(sided(found).groupBy("h", "side").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where((F.col("lo.id") != F.col("hi.id")) | (F.col("lo.b") != F.col("hi.b"))))
    # against the first and the last copy with a chain; the row itself does not count
    itself = lambda c: (F.col(f"{c}.id") == F.col("id")) & (F.col(f"{c}.b") == F.col("b"))
    alike = lambda c: F.coalesce(F.aggregate(F.zip_with("chain", F.when(~itself(c), F.col(f"{c}.chain")), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x), F.lit(0))
    rows = sided(found.join(copies, "h").withColumns({"later": later, "source": F.col("kept.id")}).drop("kept")).join(ends, ["h", "side"], "left")
    rows = rows.select("h", "side", "id", "b", "e", "source", "later", "chain", F.coalesce(itself("lo"), F.lit(True)).alias("is_lo"), F.coalesce(itself("hi"), F.lit(True)).alias("is_hi"), alike("lo").alias("n_lo"), alike("hi").alias("n_hi"))
    reach = F.greatest("n_lo", "n_hi")
    rows = cut(rows.withColumn("chain", F.when(~F.col("is_lo") & ~F.col("is_hi") & (F.size("chain") > reach), F.col("chain"))))  # of those that may reach further
    spans = lambda df, n: df.where("later").select("id", (F.col("b") - F.when(F.col("side") == 0, n).otherwise(0)).alias("b"), (F.col("e") + F.when(F.col("side") == 1, n).otherwise(0)).alias("e"), "source")
    # those two themselves, against all others
    best = cut(rows.groupBy("h", "side").agg(F.max("n_lo").alias("best_lo"), F.max("n_hi").alias("best_hi")))
    both = rows.where("is_lo or is_hi").drop("chain").join(best, ["h", "side"])
    out = inner.unionByName(spans(rows, reach)).unionByName(spans(both, F.greatest(F.when(F.col("is_lo"), F.col("best_lo")).otherwise(0), F.when(F.col("is_hi"), F.col("best_hi")).otherwise(0))))
    # the others: those that agree with each other further than with these two agree with these two alike
    beyond = cut(rows.where("chain is not null").select("h", "side", "id", "b", "e", "source", "later", "chain", reach.alias("k"), F.get("chain", reach).alias("x")))
    deeper = cut(_shared(beyond, "h", "side", "k", "x").select("h", "side", "id", "b", "e", "source", "later", F.posexplode("chain").alias("at", "x"), "k").where("at >= k").drop("k"))
    most = _shared(deeper, "h", "side", "at", "x").groupBy("side", "id", "b", "e", "source", "later").agg((F.max("at") + 1).alias("n"))
    return out.unionByName(spans(most, F.col("n")))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys another place (id, b) has too."""
    place = F.struct("id", "b")
    twice = rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(cut(twice), list(keys))


def _line_spans(lines: DataFrame, pairs: DataFrame, crowded: DataFrame, shingles: DataFrame) -> DataFrame:
    sets = cut(shingles.groupBy("h").agg(F.any_value("shingles").alias("s")).select("h", F.array_distinct("s").alias("s")))
    both = F.size(F.array_intersect("s", "t"))
    near = pairs.join(sets, "h").join(sets.select(F.col("h").alias("other"), F.col("s").alias("t")), "other").where(both >= SIMILARITY * (F.size("s") + F.size("t") - both))
    near = cut(near.select("h", "other"))
    classes = cut(connected_components(near.unionByName(block_links(crowded, near, sets)), "h", "other"))
    least = lines.groupBy("h").agg(F.min(F.struct("id", "b")).alias("kept")).join(classes, F.col("h") == F.col("node"))
    kept = cut(least.groupBy("component").agg(F.min("kept").alias("kept")))
    # a component's lines meet what is kept of it by their contents, of which a large component has many
    by_content = cut(classes.join(kept, "component").select(F.col("node").alias("h"), "kept"))
    rows = lines.select("id", "h", "b", "e").join(by_content, "h").where((F.col("id") != F.col("kept.id")) | (F.col("b") != F.col("kept.b")))
    return rows.select("id", "b", "e", F.col("kept.id").alias("source"))


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of one text up to GAP words apart become one; those of MIN_RUN words and more are returned."""
    sorted_ = spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("b", "e", "source"))).alias("all"))  # one text's own spans
    empty = F.array().cast("array<struct<b:bigint,e:bigint,source:bigint,most:bigint>>")

    def add(acc, x):
        one = lambda b, e, source, most: F.struct(b.alias("b"), e.alias("e"), source.alias("source"), most.alias("most"))
        size, end = x.e - x.b, F.element_at(acc, -1)
        wider = F.when(size > end.most, x.source).otherwise(end.source)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(end.b, F.greatest(end.e, x.e), wider, F.greatest(size, end.most))))
        return F.when((F.size(acc) > 0) & (x.b <= F.get(acc, F.size(acc) - 1).e + GAP), grown).otherwise(F.concat(acc, F.array(one(x.b, x.e, x.source, size))))

    runs = F.filter(F.aggregate("all", empty, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x.b.alias("b"), x.e.alias("e"), x.source.alias("source"), (x.e - x.b).alias("most")))).otherwise(add(acc, x))), lambda s: s.e - s.b >= MIN_RUN)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda s: F.struct((s.b - s.e).alias("size"), s.b.alias("b"), s.source.alias("source")))), 1)
    return sorted_.select("id", runs.alias("runs")).where(F.size("runs") > 0).select("id", F.transform("runs", lambda s: F.struct(s.b.alias("b"), s.e.alias("e"))).alias("spans"), longest.source.alias("source"))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans' words cut out of their texts; all columns and rows stay.

    ``id_col`` tells texts apart: rows that share an id must be given keys of their own. What lies beyond a text's end is left out.
    """
    key, marked = fresh_name("id", docs), fresh_name("spans", docs)
    joined = docs.join(spans.select(F.col("id").alias(key), F.col("spans").alias(marked)), docs[id_col].cast("long") == F.col(key), "left").select(*docs.columns, marked)
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            marks = batch.column(batch.num_columns - 1)
            texts = batch.column(where)
            if marks.null_count < len(marks):
                out = texts.to_pylist()
                for k in np.flatnonzero(~np.asarray(pc.is_null(marks))):
                    slab = next(slabs(texts.slice(k, 1)))
                    begin, _, _ = slab.words()
                    keep, at = [], 0
                    for s in marks[int(k)].as_py():
                        if s["b"] >= len(begin):
                            break
                        keep.append(slab.data[at : begin[s["b"]]].tobytes())
                        at = begin[s["e"]] if s["e"] < len(begin) else len(slab.data)
                    out[k] = b"".join([*keep, slab.data[at:].tobytes()]).decode("utf-8", "replace")
                texts = pa.array(out, texts.type)
            columns = [texts if i == where else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(lean(run), docs.schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.e - s.b)
    found = found.select(F.col("id").alias("doc_id"), F.size("spans").cast("long").alias("n_spans"), removed.alias("removed_words"), F.col("source").alias("source_doc_id"), "spans")
    none = F.lit(0).cast("long")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("removed_words", none).alias("removed_words"), "source_doc_id", "spans")


QUERIES = {"op2_substrings": op2_substrings}
SQL: dict[str, str] = {}
