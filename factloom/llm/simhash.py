"""SimHash near-duplicates by a binary trie self-join.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; shingles of consecutive words, repeats included, are joined by
spaces (fewer words: the whole sequence). A fingerprint has one or more 64-bit words: XXH64 with seed 42 of each
shingle, and mixes of it; a bit is set if it is in over half of the hashes. No words: all bits zero.

Fingerprints are taken once each, whatever the number of their copies. If two differ in at most `budget` of the
bits of a trie, then one of its blocks of bits agrees; so each block in turn leads a trie, the fingerprints that
share that block are one root node, and tasks traverse pairs of nodes together, adding up differing bits and
pruning pairs beyond the budget. Root nodes of too many fingerprints are first taken apart into pairs of child
nodes, again and again, so that no task gets an unbounded node. Tasks return a spanning forest of the links they
found, which loses no connection; components() joins the forests.

Null and empty texts have the zero fingerprint and link like any other. A row without doc_id takes the class of its
fingerprint (null where no row with an id is linked to it); rows that share an id are treated alike.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import ASCII_LOWER, bound_batches, drop_stored, id_text, map_rows, stored, whole
from factloom.llm.components import components

SEED = 42
#: Fingerprints of a root node above which it is taken apart, and the bits by which it is.
NODE_LIMIT, STEP_BITS = 20_000, 6
#: Pairs of fingerprints of two nodes below which they are compared one by one.
LEAF_PAIRS = 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int, words: int = 1) -> list[int]:
    """words 64-bit words, as signed numbers."""
    return sketch(shingle_hashes(text, size), words)


def sketch(h: np.ndarray, words: int) -> list[int]:
    out = []
    for k in range(words):
        mixed = h
        if k:  # further words: a multiplicative mix of the same hash
            mixed = (h ^ np.uint64(0xD6E8FEB86659FD93 * k & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(29)
        out.append(majority(mixed))
    return [x - (1 << 64) if x >> 63 else x for x in out]


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp array<long>; one narrow pass."""
    return map_rows(id_text(docs, id_col, text_col), lambda cols: [[fingerprint(t, size, words) for t in cols[0]]], "fp array<long>", keep=["doc_id"])


class Tries:
    """How fingerprints are laid into tries: the parts of `bits` bits of each word, and of each part the choices of leading blocks."""

    def __init__(self, words: int, bits: int, budget: int, blocks: int):
        self.bits, self.budget = bits, budget
        cuts = [bits * k // blocks for k in range(blocks + 1)]
        spans = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        orders = []
        for lead in combinations(range(blocks), blocks - budget):
            first = [b for k in lead for b in spans[k]]
            orders.append((len(first), first + [b for k in range(blocks) if k not in lead for b in spans[k]]))
        self.parts = [(w, at * bits) for w in range(words) for at in range(64 // bits)]
        self.orders = orders

    def rows(self, rep: np.ndarray, fps: np.ndarray):
        """(trie, lead, rest, rest bits) arrays for each trie: the leading bits as a number, the others from the top of a uint64."""
        trie = 0
        for word, shift in self.parts:
            part = fps[:, word].view(np.uint64) >> np.uint64(shift)
            for lead_bits, order in self.orders:
                lead, rest = np.zeros(len(rep), dtype=np.uint64), np.zeros(len(rep), dtype=np.uint64)
                for k, b in enumerate(order):
                    bit = (part >> np.uint64(b)) & np.uint64(1)
                    if k < lead_bits:
                        lead = lead << np.uint64(1) | bit
                    else:
                        rest |= bit << np.uint64(63 - (k - lead_bits))
                yield trie, lead, rest
                trie += 1


def trie_rows(distinct: DataFrame, tries: Tries) -> DataFrame:
    """Each fingerprint once for each trie: node (trie, lead), side 0 (the node is joined with itself), spent 0, rest, depth 0."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rep = batch.column("rep").to_numpy(zero_copy_only=False)
                fps = np.array(batch.column("fp").to_pylist(), dtype=np.int64)
                n = batch.num_rows
                for trie, lead, rest in tries.rows(rep, fps):
                    node = lead.astype(np.int64) * 4096 + trie
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node), pa.array(np.zeros(n, np.int8)), pa.array(np.zeros(n, np.int8)), pa.array(rest.view(np.int64)), batch.column("rep"), batch.column("fp")],
                        names=["node", "side", "spent", "rest", "rep", "fp"],
                    )

    return distinct.mapInArrow(run, "node long, side byte, spent byte, rest long, rep long, fp array<long>")


def take_apart(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of large nodes under the pairs of their children that differ in no more bits than the budget has left."""
    masks = [(m, bin(m).count("1")) for m in range(1 << STEP_BITS) if bin(m).count("1") <= budget]
    child = F.shiftrightunsigned("rest", 64 - STEP_BITS)
    pairs = rows.withColumn("child", child).withColumn("m", F.explode(F.array([F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).cast("byte").alias("bits")) for m, n in masks])))
    pairs = pairs.where(F.col("spent") + F.col("m.bits") <= budget)
    other = F.col("child").bitwiseXOR(F.col("m.mask"))
    # of a node joined with itself, the child with the smaller number is the left side of each pair
    side = F.when((F.col("side") == 0) & (F.col("m.mask") != 0), F.when(F.col("child") < other, 1).otherwise(2)).otherwise(F.col("side")).cast("byte")
    left = F.when(side == 2, other).otherwise(F.col("child"))
    right = F.when(side == 2, F.col("child")).otherwise(other)
    return pairs.select(
        F.xxhash64("node", left, right, F.col("side") == 0).alias("node"), side.alias("side"), (F.col("spent") + F.col("m.bits")).cast("byte").alias("spent"),
        F.shiftleft("rest", STEP_BITS).alias("rest"), "rep", "fp",
    )


def traverse(starts: np.ndarray, sides: np.ndarray, spent: np.ndarray, rest: np.ndarray, budget: int):
    """Pairs of positions (two arrays) whose nodes' differing bits stay within the budget, and sets of positions
    (one array, and None) any two of which are such pairs; rows are sorted by (node, side, rest).

    starts: where each (node, side) begins, and the end; sides and spent: of each of them.
    """
    lo, hi = starts[:-1], starts[1:]
    own = np.flatnonzero(sides == 0)
    ones, = np.nonzero(sides == 1)
    pair = ones[(ones + 1 < len(sides))]
    pair = pair[sides[pair + 1] == 2]
    alo, ahi = np.concatenate([lo[own], lo[pair]]), np.concatenate([hi[own], hi[pair]])
    blo, bhi = np.concatenate([lo[own], lo[pair + 1]]), np.concatenate([hi[own], hi[pair + 1]])
    err = np.concatenate([spent[own], spent[pair]]).astype(np.int64)
    for depth in range(65):
        same = alo == blo
        live = (err <= budget) & (ahi > alo) & (bhi > blo) & ~(same & (ahi - alo < 2))
        alo, ahi, blo, bhi, err, same = (x[live] for x in (alo, ahi, blo, bhi, err, same))
        if not len(alo):
            return
        leaf = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        if leaf.any():
            yield from pairs_of(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
        if depth == 64:  # what is left agrees in all bits of the trie
            for a in zip(*(x[~leaf].tolist() for x in (alo, ahi, blo, bhi)), strict=True):
                yield np.unique(np.concatenate([np.arange(*a[:2]), np.arange(*a[2:])])), None
        if depth == 64 or leaf.all():
            return
        alo, ahi, blo, bhi, err, same = (x[~leaf] for x in (alo, ahi, blo, bhi, err, same))
        bit = np.concatenate([[0], np.cumsum((rest >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        amid, bmid = ahi - (bit[ahi] - bit[alo]), bhi - (bit[bhi] - bit[blo])
        cross = ~same
        parts = [
            (alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], err[cross] + 1),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))


def pairs_of(alo, ahi, blo, bhi, most: int = 1 << 20):
    """All pairs of positions of the given pairs of ranges, about `most` at a time."""
    width, counts = bhi - blo, (ahi - alo) * (bhi - blo)
    done, ends = 0, np.cumsum(counts)
    while done < len(counts):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, side="right")))
        c = counts[done:upto]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        w = np.repeat(width[done:upto], c)
        i, j = np.repeat(alo[done:upto], c) + k // w, np.repeat(blo[done:upto], c) + k % w
        keep = i != j
        yield i[keep], j[keep]
        done = upto


def forest(n: int, candidates, near) -> np.ndarray:
    """The smallest position that each of n positions is linked to.

    Of the candidates (arrays i and j of pairs, or a set i and None) those not yet connected are linked if near() says so.
    """
    root = np.arange(n)
    for i, j in candidates:
        if j is None:
            root = link_set(root, np.unique(i), near)
        else:
            apart = root[i] != root[j]
            root = link(root, i[apart], j[apart], near)
    return root


def link(root: np.ndarray, i: np.ndarray, j: np.ndarray, near) -> np.ndarray:
    keep = near(i, j)
    i, j = i[keep], j[keep]
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def link_set(root: np.ndarray, members: np.ndarray, near) -> np.ndarray:
    """All links between members: each is compared with those that are not connected to the first one's class, which in a group of near copies are soon none."""
    rest = members[1:]
    for m in members:
        open_ = rest[root[rest] != root[m]]
        if len(open_):
            root = link(root, np.full(len(open_), m), open_, near)
        rest = rest[root[rest] != root[members[0]]]
        if not len(rest):
            break
    return root


def near_links(distinct: DataFrame, tries: Tries, total: int) -> DataFrame:
    """a, b: a forest of the links between the rows of distinct (rep long, fp array<long>) that differ in at most total bits."""
    budget = tries.budget
    rows = stored(trie_rows(distinct, tries), "trie-rows")
    ready, taken = [], 0
    while True:
        sizes = rows.groupBy("node").count()
        large = stored(sizes.where(F.col("count") > NODE_LIMIT).select("node"), "trie-large")
        # fingerprints that agree in all bits of a trie cannot be taken apart by them: link_set() bounds their work
        if taken >= tries.bits or large.isEmpty():
            ready.append(rows)
            break
        taken += STEP_BITS
        ready.append(rows.join(large, "node", "left_anti"))
        rows = stored(take_apart(rows.join(large, "node", "left_semi"), budget), "trie-rows")
    todo = ready[0]
    for more in ready[1:]:
        todo = todo.unionByName(more)

    def run(batches):
        table = whole(batches)
        if table is None:
            return
        node, side, spent, rest, rep = (table.column(c).combine_chunks().to_numpy() for c in ("node", "side", "spent", "rest", "rep"))
        rest = rest.view(np.uint64)
        order = np.lexsort((rest, side, node))
        node, side, spent, rest, rep = node[order], side[order], spent[order], rest[order], rep[order]
        words = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])]))
        same_node = np.concatenate([node[first], [0]])
        sides = side[first].astype(np.int64)
        # a left side whose right side is missing has nothing to meet
        sides[np.flatnonzero((sides == 1) & (np.concatenate([same_node[1:-1], [0]]) != same_node[:-1]))] = 3

        reps, at, place = np.unique(rep, return_index=True, return_inverse=True)
        words = words[at]
        found = traverse(np.concatenate([first, [len(node)]]), sides, spent[first], rest, budget)
        root = forest(len(reps), ((place[i], None if j is None else place[j]) for i, j in found), lambda i, j: np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= total)
        moved = np.flatnonzero(root != np.arange(len(reps)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(reps[root[moved]]), pa.array(reps[moved])], names=["a", "b"])

    return todo.repartition("node").mapInArrow(run, "a long, b long")


#: Of how many MinHash values how many bands consist: a pair of similarity 0.8 misses all bands with a probability of 0.0002.
BAND, BANDS = 4, 16
#: Rows, and shingles, of a group that one task compares; larger groups are dealt out. Rows to which each part of a large group is compared first.
CELL_ROWS, CELL_SHINGLES, LEADERS = 4096, 4 << 20, 32


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (of distinct shingles), whole (a hash of the set of shingles), n (how many), bands array<long>."""
    rng = np.random.default_rng(SEED)
    odd, plus = (rng.integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def run(cols):
        out = [[], [], [], []]
        for text in cols[0]:
            h = np.unique(shingle_hashes(text, size))
            out[0].append(sketch(h, 1))
            out[1].append(xxhash.xxh3_128_digest(h.tobytes()))
            out[2].append(len(h))
            if len(h):
                least = np.full(BAND * BANDS, np.uint64(0xFFFFFFFFFFFFFFFF))
                for k in range(BAND * BANDS):
                    mixed = (h ^ plus[k]) * odd[k]
                    mixed ^= mixed >> np.uint64(32)
                    least[k] = (mixed * odd[k]).min()
                out[3].append([xxhash.xxh64_intdigest(bytes([k]) + least[k * BAND : (k + 1) * BAND].tobytes()) - (1 << 63) for k in range(BANDS)])
            else:
                out[3].append([])
        return out

    return map_rows(id_text(docs), run, "fp array<long>, whole binary, n int, bands array<long>", keep=["doc_id"])


def set_links(sets: list[np.ndarray], asks: np.ndarray, least: float) -> np.ndarray:
    """The smallest position that each set is linked to by similarities of at least `least`, exactly.

    The set whose elements are the most frequent is compared with all others, then each that asks with all that are
    not of its own class. One of the first set's class has no need to ask where all others ask themselves: in a group of
    near copies that is soon done.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    root = np.arange(len(sets))
    none = np.flatnonzero(sizes == 0)
    if len(none):
        root[none] = none[0]
    some = np.flatnonzero(sizes)
    if len(some) < 2:
        return root
    _, flat, frequency = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True, return_counts=True)
    begins = np.cumsum(sizes[some]) - sizes[some]
    central = int(np.argmax(np.add.reduceat(frequency[flat], begins) / sizes[some]))
    mark = np.zeros(len(frequency), dtype=bool)
    for k in [central, *range(len(some))]:
        own = some[k]
        if (root[some] == root[some[0]]).all():
            break
        if k != central and (not asks[own] or root[own] == root[some[central]] and asks[some[root[some] != root[own]]].all()):
            continue
        elements = flat[begins[k] : begins[k] + sizes[own]]
        mark[elements] = True
        both = np.add.reduceat(mark[flat], begins, dtype=np.int64)
        mark[elements] = False
        near = some[both >= least * (sizes[own] + sizes[some] - both)]
        classes = np.unique(root[near])
        root[np.isin(root, classes)] = classes[0]
    return root


def cell_links(rows: DataFrame, least: float) -> DataFrame:
    """a, b: links within each cell of rows (cell, rep, asks, shingles); a task has one cell at a time in memory."""

    def links(parts):
        table = pa.Table.from_batches(parts)
        rep, first = np.unique(table.column("rep").to_numpy(), return_index=True)
        sets, asks = table.column("shingles").combine_chunks(), table.column("asks").to_numpy()
        root = set_links([sets[int(k)].values.to_numpy() for k in first], asks[first], least)
        moved = np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[root[moved]]), pa.array(rep[moved])], names=["a", "b"])

    def run(batches):
        parts, cell = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if parts and cells[at] != cell:
                    yield links(parts)
                    parts = []
                cell = cells[at]
                parts.append(batch.slice(at, end - at))
        if parts:
            yield links(parts)

    bound_batches(rows.sparkSession)
    ordered = rows.select("cell", "rep", "asks", "shingles").repartition("cell").sortWithinPartitions("cell", F.desc("asks"))
    return ordered.mapInArrow(run, "a long, b long")


def verified_links(distinct: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """a, b: links between the rows of distinct (rep, fp, n, bands) that connect all candidates of at least this similarity.

    Of rows that share an id one text is compared. Candidates are the members of a group: of a component of the trie join, or of a MinHash band; groups of equal
    members count once. The members' sets go to the group's cell, where similarities are counted exactly. A group
    beyond a cell's bounds is cut into parts: each part meets the same few leaders and itself, and in a second pass
    the rows that are not of the class of most meet all parts, a pack of them at a time.
    """
    trie = components(near_links(distinct.select("fp", "rep"), Tries(1, 64, 2, 4), 2))
    trie = trie.select("root", F.col("node").alias("rep")).union(trie.select("root", F.col("root").alias("rep")).distinct())
    rows = distinct.select(F.explode("bands").alias("grp"), "rep").unionByName(trie.select(F.xxhash64(F.lit("trie"), "root").alias("grp"), "rep"))
    rows = stored(rows.join(distinct.select("rep", F.col("n").alias("shingled")).hint("merge"), "rep"), "near-groups")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"), F.sum(F.col("shingled").cast("long")).alias("m"))
    sizes = sizes.where("n > 1").groupBy("n", "sign", "m").agg(F.min("grp").alias("grp"))
    parts = F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("m") / CELL_SHINGLES)).cast("int")
    members = stored(rows.join(sizes.select("grp", "n", parts.alias("parts")).hint("merge"), "grp").select("grp", "rep", "n", "parts"), "near-members")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    some = texts.join(ids.hint("merge"), "doc_id", "left_semi")
    sets = map_rows(id_text(some), lambda cols: [[np.unique(shingle_hashes(t, size)).view(np.int64) for t in cols[0]]], "shingles array<long>", keep=["doc_id"])
    # rows that share an id share its class: one of their texts stands for them
    sets = stored(sets.groupBy(F.col("doc_id").alias("rep")).agg(F.first("shingles").alias("shingles")), "shingle-sets")
    with_sets = lambda cells: cells.join(sets.hint("merge"), "rep")
    part, every = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    leads = F.pmod(F.xxhash64("rep", "grp"), F.col("n")) < LEADERS
    large = members.where("parts > 1")
    cells = members.select("grp", "rep", part.alias("part")).unionByName(large.where(leads).select("grp", "rep", every.alias("part")))
    links = stored(cell_links(with_sets(cells.select(F.xxhash64("grp", "part").alias("cell"), "rep", F.lit(True).alias("asks"))), least), "near-links")
    if not large.isEmpty():
        classed = large.join(components(links).hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("root", "rep"))
        most = classed.groupBy("grp", "class").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("top"))
        packs = F.ceil((F.col("all") - F.col("top")) / CELL_ROWS).cast("int")
        classed = classed.join(most.select("grp", "main", packs.alias("packs")).hint("merge"), "grp").where("packs > 0")
        asking = classed.where("class <> main").select("grp", "rep", F.pmod(F.xxhash64("rep"), F.col("packs")).cast("int").alias("pack"), every.alias("part"), F.lit(True).alias("asks"))
        asked = classed.select("grp", "rep", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), part.alias("part"), F.lit(False).alias("asks"))
        more = asking.unionByName(asked).select(F.xxhash64("grp", "pack", "part").alias("cell"), "rep", "asks")
        links = links.unionByName(stored(cell_links(with_sets(more), least), "near-links"))
    for table in (rows, members, sets):
        drop_stored(table)
    return links


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp array<long>, component_id: the smallest doc_id reachable over links of `budget` or fewer differing bits, exactly.

    Shuffled are ids and fingerprints, never texts. doc_id is a whole number.
    """
    marked = stored(fingerprints(docs, size, 1, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    distinct = stored(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints-distinct")
    roots = components(near_links(distinct, Tries(1, 64, budget, blocks), budget))
    classes = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(stored(classes, "fingerprint-classes"), "fp", "left").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over pairs of documents whose sets of distinct shingles have a similarity of at least `least`, counted exactly.

    Candidates come by the trie join of the sets' fingerprints and by MinHash bands; shuffled are ids, sketches, and
    the candidates' texts and sets. Documents of equal sets are one. doc_id is a whole number; a null id has the class
    of the documents of its set, if there are any.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = stored(sketches(texts, size), "sketches")
    distinct = stored(marked.where("doc_id IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("rep")), "sets-distinct")
    first = distinct.withColumn("doc_id", F.col("rep")).hint("merge")
    own = marked.join(first, ["whole", "doc_id"]).groupBy("rep").agg(F.max_by(F.struct("fp", "n", "bands"), "whole").alias("own"))
    own = stored(own.select("rep", "own.*"), "sketches-distinct")
    roots = components(verified_links(own, texts, size, least))
    classes = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("whole", F.coalesce("root", "rep").alias("component_id"))
    out = stored(marked.select("doc_id", "whole").join(stored(classes, "set-classes"), "whole", "left").select("doc_id", "component_id"), "near-classes")
    for table in (marked, own):
        drop_stored(table)
    return out


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs without those that a smaller doc_id stands for (similar_documents); all columns as they are."""
    found = similar_documents(docs.select("doc_id", text_col), size, least, text_col=text_col)
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-gone")
    # a merge join at every size: the plan of a small table is the plan of a large one
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
