"""Exact n-gram Jaccard join of documents, verified by signature trees.

1. A document is the set of its distinct word shingles (hashed); equal sets are one class.
2. In one global order of shingles, long (rare) ones first and known frequent ones last, two
   sets that are similar enough share a shingle of their prefixes. Prefix shingles of more
   than ``SMALL_CELL`` classes are declared frequent, ordered last, and the sets that used
   them are dealt anew. A shingle of fewer classes proposes its pairs; those whose token
   bitmaps (the leaves of the trees) leave too small a possible overlap are dropped.
3. Classes connected by pairs, or by a shingle that still has many classes, are a family. A
   family that fits into one block is joined with itself in one task by a signature tree:
   nodes hold OR-combined token bitmaps and size ranges, and the dual traversal drops node
   pairs whose greatest possible overlap is too small. Each set is shuffled once for that.
4. Of a larger family, what many classes share is cut into blocks by size and every pair of
   blocks of compatible size is joined by two trees; of its other pairs those not yet
   connected are verified.
5. Tasks keep a forest of what they have linked, so a family of g near copies yields at most
   g - 1 links per task, not its pairs; components of the links give the groups.

Nothing is capped or sampled: the frequent set only changes the order, which the prefix
argument allows to be any fixed one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, mix64, text_groups, word_hashes
from .components import connected_components

#: Classes that may share a prefix shingle before it counts as frequent.
SMALL_CELL = 64
#: Most frequent shingles that are broadcast (8 bytes each); others only cost time.
MAX_FREQUENT = 1_000_000
#: Ids up to which a filter is broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles and sets in a block of a family.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 4096
LEAF, FAN_OUT = 32, 8
#: Characters of texts described together.
GROUP_CHARS = 1 << 18
_LEN_BITS, _HASH_BITS = 8, 55
#: Bits of a class key; sets that share one are told apart by 64 further bits.
KEY_BITS, MAX_CLASHES = 64, 100_000
#: Rounds of declaring frequent shingles.
DEALS = 2


@dataclass(frozen=True)
class Similarity:
    """Jaccard threshold num / den on shingles of k words."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n):
        return n - (self.num * n + self.den - 1) // self.den + 1

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def shingle_sets(texts, k: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text in the global order, one after the other, and where
    each text's begin (one more entry at the end). A token's high bits are 255 minus its
    length in bytes, so the natural order puts long shingles first; ``frequent`` ones
    (sorted) come after all others. Texts of fewer than k words are one shingle."""
    h, size, at = word_hashes(texts)
    count = np.diff(at)
    n_docs = len(count)
    doc, token = [], []
    if len(h):
        whole = len(h) - k + 1
        if whole > 0:
            s, length = h[:whole].copy(), size[:whole].copy()
            for j in range(1, k):
                s = mix64(s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + whole])
                length += size[j : j + whole]
            owner = np.repeat(np.arange(n_docs), count)
            valid = owner[:whole] == owner[k - 1 :]
            doc.append(owner[:whole][valid])
            token.append(_token(s[valid], length[valid]))
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            s, length = np.full(len(short), 0x1234567, np.uint64), np.zeros(len(short), np.int64)
            for j in range(k - 1):
                has = count[short] > j
                pos = at[short[has]] + j
                s[has] = mix64(s[has] * np.uint64(0xA0761D6478BD642F) + h[pos])
                length[has] += size[pos]
            doc.append(short)
            token.append(_token(s, length))
    if not doc:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    doc, token = np.concatenate(doc), np.concatenate(token)
    key = token
    if frequent is not None and len(frequent):
        slot = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
        key = token + (frequent[slot] == token).astype(np.int64) * np.int64(-(1 << 63))
        key = key.view(np.uint64)
    order = np.lexsort((key, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    return token, np.searchsorted(doc, np.arange(n_docs + 1))


def _token(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    return ((np.uint64(255) - np.minimum(length, 255).astype(np.uint64)) << np.uint64(_HASH_BITS) | hashes >> np.uint64(64 - _HASH_BITS)).view(np.int64)


def class_keys(token: np.ndarray, at: np.ndarray, clashes: np.ndarray | None = None, bits: int = KEY_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys per set, independent of the order of its tokens. The first names its class;
    where ``clashes`` tells that different sets share one, the second is mixed in."""
    n = np.diff(at)
    out, other = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(token):
        m = mix64(token.view(np.uint64))
        full = n > 0
        total, xor = np.add.reduceat(m, at[:-1][full]), np.bitwise_xor.reduceat(m, at[:-1][full])
        out[full] = mix64(mix64(total ^ n[full].astype(np.uint64)) + xor) >> np.uint64(64 - bits)
        other[full] = mix64(np.add.reduceat(mix64(m ^ np.uint64(0xA0761D6478BD642F)), at[:-1][full]) + xor)
        if clashes is not None and len(clashes):
            shared = np.isin(out.view(np.int64), clashes)
            out[shared] = mix64(out[shared] ^ other[shared])
    return out.view(np.int64), other.view(np.int64)


def packed_set(tokens: np.ndarray) -> bytes:
    """A set for verification, as 5 bytes a token: the low 40 bits of the hashes, sorted, the
    low 32 bits of all and then the rest. Two sets of n tokens with m own ones each agree by
    chance in one of these with a probability of about m * m / 10^12."""
    v = np.unique(tokens.view(np.uint64) & np.uint64((1 << 40) - 1))
    return v.astype("<u4").tobytes() + (v >> np.uint64(32)).astype(np.uint8).tobytes()


def unpacked_set(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return (np.frombuffer(raw, "<u4", n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64) << 32)


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of a set: the least power of two bits (64 at least) that is not below its size."""
    bits = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    b = (tokens.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(b, minlength=bits) > 0, bitorder="little").tobytes()


def _most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """Greatest possible overlap of two sets by their bitmaps; the larger one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    common, own = int(np.bitwise_count(x & y).sum()), min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))
    return min(common + own, n_a, n_b)


def _may_link(sim: Similarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["su"], pdf["nu"].tolist(), pdf["sv"], pdf["nv"].tolist())
            hit = [sim.linked(_most_common(a, n, b, m), n, m) for a, n, b, m in rows]
            yield pdf.loc[hit, ["u", "v"]]

    return run


def _describe(sim: Similarity, frequent, payload: str, clashes: np.ndarray | None = None):
    """mapInPandas body: (id, text) to (doc_id, n, cls, chk) with the prefix or the whole set as payload."""
    bits = KEY_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = frequent.value if frequent is not None else None
        for pdf in batches:
            lo = 0
            for group in text_groups(pdf["text"], GROUP_CHARS):
                ids = pdf["doc_id"].iloc[lo : lo + len(group)]
                lo += len(group)
                token, at = shingle_sets(group, sim.k, hot)
                n = np.diff(at)
                if payload == "family":  # of a document's rows only those of the wanted class
                    part = pdf.iloc[lo - len(group) : lo]
                    cls, _ = class_keys(token, at, clashes, bits)
                    keep = np.flatnonzero(cls == part["want"].to_numpy())
                    yield pd.DataFrame({"cls": cls[keep], "fam": part["fam"].to_numpy()[keep], "fits": part["fits"].to_numpy()[keep], "tokens": [packed_set(token[at[i] : at[i + 1]]) for i in keep]})
                    continue
                cls, chk = class_keys(token, at, clashes, bits)
                out = pd.DataFrame({"doc_id": ids.to_numpy(), "n": n, "cls": cls, "chk": chk})
                if payload == "prefix":
                    out["prefix"] = [token[a : a + p] for a, p in zip(at, np.where(n > 0, sim.prefix(n), 0))]
                    out["sig"] = [signature(token[a:b]) for a, b in zip(at, at[1:])]
                else:
                    out["tokens"] = [packed_set(token[a:b]) for a, b in zip(at, at[1:])]
                yield out

    return run


def _few(ids: DataFrame) -> DataFrame:
    """A broadcast of ids where those are at most ``BROADCAST_IDS``, else the ids as they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _rows(reps: DataFrame) -> DataFrame:
    return reps.select(F.explode("prefix").alias("token"), "cls", "n")


def _frequent(rows: DataFrame) -> np.ndarray:
    """The most frequent shingles of more than ``SMALL_CELL`` classes, sorted; at most ``MAX_FREQUENT``."""
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SMALL_CELL)
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("c"), "token").limit(MAX_FREQUENT).select("token").toLocalIterator()], np.int64))


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        b = s.view(np.uint64) & np.uint64(bits - 1)
        np.bitwise_or.at(out[i], (b >> np.uint64(3)).astype(np.int64), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))
    return out.view(np.uint64)


class SignatureTree:
    """Nodes over sets sorted by size, leaves first, ``FAN_OUT`` nodes under one: OR of the
    bitmaps, least and greatest size, greatest number of tokens that share a bit of their set."""

    def __init__(self, size: np.ndarray, maps: np.ndarray):
        self.order = np.lexsort((maps[:, 0], size))
        size, maps = size[self.order], maps[self.order]
        node, step = (maps, size, size, size - np.bitwise_count(maps).sum(1).astype(np.int64)), LEAF
        self.levels = []
        while not self.levels or len(node[1]) > 1:
            cut = np.arange(0, len(node[1]), step)
            node = tuple(f.reduceat(x, cut, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), node))
            self.levels.append(node)
            step = FAN_OUT

    def below(self, level: int, node: np.ndarray) -> list[np.ndarray]:
        return [np.arange(i * FAN_OUT, min((i + 1) * FAN_OUT, len(self.levels[level - 1][1]))) for i in node]


def possible(a: tuple, b: tuple, pairs: np.ndarray, sim: Similarity) -> np.ndarray:
    """Which pairs of nodes (rows: index into ``a``, into ``b``) may hold linked sets."""
    (ma, la, ha, ea), (mb, lb, hb, eb) = (tuple(x[pairs[:, k]] for x in t) for k, t in enumerate((a, b)))
    common = np.bitwise_count(ma & mb).sum(1).astype(np.int64)
    most = np.minimum(common + np.minimum(ea, eb), np.minimum(ha, hb))
    fits = (sim.den * ha >= sim.num * lb) & (sim.den * hb >= sim.num * la)
    return fits & ((sim.den + sim.num) * most >= sim.num * (la + lb))


def leaf_pairs(a: SignatureTree, b: SignatureTree, sim: Similarity) -> np.ndarray:
    """Dual traversal from the roots: pairs of leaves that may hold linked sets."""
    pairs, la, lb = np.zeros((1, 2), np.int64), len(a.levels) - 1, len(b.levels) - 1
    while len(pairs) and (la or lb):
        deeper_a = la >= lb
        below = a.below(la, pairs[:, 0]) if deeper_a else b.below(lb, pairs[:, 1])
        fan = np.array([len(x) for x in below])
        pairs = np.repeat(pairs, fan, axis=0)
        pairs[:, 0 if deeper_a else 1] = np.concatenate(below)
        la, lb = la - deeper_a, lb - (not deeper_a)
        if a is b and la == lb:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        pairs = pairs[np.concatenate([possible(a.levels[la], b.levels[lb], pairs[k : k + 4096], sim) for k in range(0, len(pairs), 4096)])]
    return pairs


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, sim: Similarity) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``left`` and ``right`` sets (sorted tokens), or
    within ``left``: a spanning forest, as indices into both lists together."""
    same = right is None
    both = left if same else left + right
    if len(both) < 2 or not left or right == []:
        return []
    size = np.array([len(s) for s in both])
    bits = 1 << min(17, max(9, math.ceil(math.log2(4 * size.max() + 1))))
    maps = _bitmaps(both, bits)
    parent = list(range(len(both)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    la, lb = np.arange(len(left)), np.arange(len(left)) if same else np.arange(len(left), len(both))
    ta = SignatureTree(size[la], maps[la])
    tb = ta if same else SignatureTree(size[lb], maps[lb])
    oa, ob = la[ta.order], lb[tb.order]
    links = []
    for x, y in leaf_pairs(ta, tb, sim):
        ia, ib = oa[x * LEAF : (x + 1) * LEAF], ob[y * LEAF : (y + 1) * LEAF]
        ma, mb, sa, sb = maps[ia], maps[ib], size[ia], size[ib]
        common = np.stack([np.bitwise_count(r & mb).sum(1) for r in ma]).astype(np.int64)
        pa, pb = np.bitwise_count(ma).sum(1).astype(np.int64), np.bitwise_count(mb).sum(1).astype(np.int64)
        most = np.minimum(common + (sa - pa)[:, None], common + (sb - pb)[None, :])
        may = (sim.den + sim.num) * most >= sim.num * (sa[:, None] + sb[None, :])
        if same and x == y:
            may &= np.arange(len(ia))[:, None] < np.arange(len(ib))[None, :]
        for p, q in np.argwhere(may):
            u, v = int(ia[p]), int(ib[q])
            ru, rv = root(u), root(v)
            if ru != rv and sim.linked(_common(both[u], both[v]), len(both[u]), len(both[v])):
                parent[ru] = rv
                links.append((u, v))
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verify(sim: Similarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = ([unpacked_set(t) for t in pdf[c]] for c in ("ta", "tb"))
            hit = [sim.linked(_common(x, y), len(x), len(y)) for x, y in zip(a, b)]
            yield pdf.loc[hit, ["u", "v"]]

    return run


def _join_families(sim: Similarity):
    """mapInPandas body over rows sorted by family: links within each family, which fits in memory."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [unpacked_set(t) for _, _, t in rows]
        return [(int(rows[a][1]), int(rows[b][1])) for a, b in tree_links(sets, None, sim)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            found = []
            for row in zip(pdf["fam"].tolist(), pdf["cls"].tolist(), pdf["tokens"]):
                if held and held[0][0] != row[0]:
                    found += links(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(links(held), columns=["u", "v"], dtype="int64")

    return run


def _join_blocks(sim: Similarity):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cls"])
        sets = [unpacked_set(t) for t in pdf["tokens"]]
        cls, split = pdf["cls"].to_numpy(), int((pdf["side"] == 0).sum())
        within = key[1] == key[3] and key[2] == key[4]
        links = tree_links(sets, None, sim) if within else tree_links(sets[:split], sets[split:], sim)
        return pd.DataFrame([(int(cls[a]), int(cls[b])) for a, b in links], columns=["u", "v"])

    return run


def _family_links(rows: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Links within families: ``rows`` (token, cls, n) of the shingles that many classes share."""
    hub = rows.groupBy("token").agg(F.min("cls").alias("hub"))
    spokes = rows.join(hub, "token").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()
    family = connected_components(spokes).select(F.col("node").alias("cls"), F.col("component").alias("fam"))
    ratio = math.log(sim.den / sim.num) * (1 + 1e-9)
    member = materialize(rows.select("cls", "n").distinct().join(family, "cls").withColumn("band", F.floor(F.log(F.col("n")) / F.lit(ratio)).cast("long")))
    w = W.partitionBy("fam").orderBy("band")
    bands = member.groupBy("fam", "band").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count(F.lit(1)) / F.lit(BLOCK_SETS))).cast("long").alias("blocks"))
    bands = bands.withColumn("below", F.when(F.lag("band").over(w) == F.col("band") - 1, F.lag("blocks").over(w)).otherwise(0)).withColumn(
        "above", F.when(F.lead("band").over(w) == F.col("band") + 1, F.lead("blocks").over(w)).otherwise(0)
    )
    m = member.join(bands, ["fam", "band"]).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")))

    def keys(count, make):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), make)).otherwise(F.array())

    def key(b1, i1, b2, i2, side):
        return F.struct(b1.alias("b1"), i1.alias("i1"), b2.alias("b2"), i2.alias("i2"), side.cast("int").alias("side"))

    band, i = F.col("band"), F.col("i")
    own = keys(F.col("blocks"), lambda j: key(band, F.least(i, j), band, F.greatest(i, j), i > j))
    up = keys(F.col("above"), lambda j: key(band, i, band + 1, j, F.lit(False)))
    down = keys(F.col("below"), lambda j: key(band - 1, j, band, i, F.lit(True)))
    dealt = m.select("fam", "cls", F.explode(F.concat(own, up, down)).alias("k")).select("fam", "k.*", "cls").join(sets, "cls")
    return dealt.groupBy("fam", "b1", "i1", "b2", "i2").applyInPandas(_join_blocks(sim), "u long, v long")


def _large_links(many: DataFrame, pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Links within families of more than a block: blocks for shingles of many classes, and of
    the pairs those that the blocks have not connected."""
    links = materialize(_family_links(many, sets, sim))
    done = materialize(connected_components(links))
    for side in ("u", "v"):
        pairs = pairs.join(done.select(F.col("node").alias(side), F.col("component").alias(f"g{side}")), side, "left")
    open_pairs = materialize(pairs.where(F.coalesce("gu", "u") != F.coalesce("gv", "v")).select("u", "v"))
    a, b = (sets.select(F.col("cls").alias(k), F.col("tokens").alias(t)) for k, t in (("u", "ta"), ("v", "tb")))
    return links.unionByName(open_pairs.join(a, "u").join(b, "v").select("u", "v", "ta", "tb").mapInPandas(_verify(sim), "u long, v long"))


def jaccard_components(docs: DataFrame, sim: Similarity = Similarity(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links).

    Words are runs of non-white-space, A-Z lower-cased. Null or wordless texts have no
    shingles and link with nothing; equal sets link; rows that repeat an id are one document
    that has the links of each; a null id stays null, with a null component; an empty table
    gives no rows; further columns are ignored."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs, nameless = given.where("doc_id IS NOT NULL"), given.where("doc_id IS NULL")
    form = "doc_id long, n long, cls long, chk long, prefix array<long>, sig binary"
    described, clashes = materialize(docs.mapInPandas(_describe(sim, None, "prefix"), form)), None
    while True:  # once, unless different sets share a key: a few of 10^10
        known = described.where("n > 0")
        reps = known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min_by("prefix", "doc_id").alias("prefix"), F.min_by("sig", "doc_id").alias("sig"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))
        reps = materialize(reps)
        shared = reps.where("c0 <> c1").select("cls").limit(MAX_CLASHES + 1).toArrow()["cls"].to_numpy()
        if not len(shared):
            break
        if clashes is not None or len(shared) > MAX_CLASHES:
            raise RuntimeError("class keys clash")
        clashes = shared
        described = materialize(docs.mapInPandas(_describe(sim, None, "prefix", clashes), form))

    # all prefixes follow one order after every round: whatever set has a fresh shingle is dealt anew
    dealt, frequent = reps.select("cls", "n", "prefix"), np.zeros(0, np.int64)
    for _ in range(DEALS):
        fresh = np.setdiff1d(_frequent(_rows(dealt)), frequent)
        if not len(fresh):
            break
        frequent = np.union1d(frequent, fresh)
        hits = _rows(dealt).join(F.broadcast(spark.createDataFrame(pd.DataFrame({"token": fresh}))), "token").select("cls").distinct()
        again = materialize(hits.join(reps.select("cls", "rep"), "cls"))
        anew = docs.join(_few(again.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInPandas(_describe(sim, spark.sparkContext.broadcast(frequent), "prefix", clashes), form)
        anew = materialize(anew.select("cls", "n", "prefix").join(_few(again.select("cls")), "cls", "left_semi").dropDuplicates(["cls"]))
        dealt = dealt.join(_few(again.select("cls")), "cls", "left_anti").unionByName(anew)
    rows = _rows(dealt)

    # classes of a shingle: pairs of compatible size where they are few, else spokes to one of them
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("hub")).where("c > 1")
    shared = rows.join(shared, "token")
    cell = shared.where(F.col("c") <= SMALL_CELL).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "cls"))).alias("m"))  # at most SMALL_CELL
    pair = cell.select("m", F.posexplode("m").alias("p", "a")).select("a", F.explode(F.expr("slice(m, p + 2, size(m))")).alias("b"))
    pair = pair.where((F.col("a.n") * sim.den >= F.col("b.n") * sim.num) & (F.col("a.cls") != F.col("b.cls")))
    pairs = pair.select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).distinct()
    for side in ("u", "v"):
        pairs = pairs.join(reps.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}")), side)
    pairs = materialize(pairs.mapInPandas(_may_link(sim), "u long, v long"))
    many = materialize(shared.where(F.col("c") > SMALL_CELL).select("token", "cls", "n", "hub"))
    spokes = many.where("cls <> hub").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()
    family = materialize(connected_components(pairs.unionByName(spokes)).select(F.col("node").alias("cls"), F.col("component").alias("fam")))
    ids = family.join(reps.select("cls", "n", F.col("rep").alias("doc_id")), "cls")
    size = ids.groupBy("fam").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("members"))
    fits = (F.col("tokens") <= BLOCK_SHINGLES) & (F.col("members") <= BLOCK_SETS)
    ids = materialize(ids.join(size.select("fam", fits.alias("fits")), "fam"))

    wanted = ids.select("doc_id", F.col("cls").alias("want"), "fam", "fits")
    whole = docs.join(_few(wanted), "doc_id").mapInPandas(_describe(sim, None, "family", clashes), "cls long, fam long, fits boolean, tokens binary")
    whole = materialize(whole)
    links = whole.where("fits").select("fam", "cls", "tokens").repartition("fam").sortWithinPartitions("fam", "cls").mapInPandas(_join_families(sim), "u long, v long")
    large = ids.where("NOT fits").select("cls")
    if large.limit(1).count():
        sets = whole.where("NOT fits").select("cls", "tokens")
        links = links.unionByName(_large_links(many.join(large, "cls", "left_semi").drop("hub"), pairs.join(large.withColumnRenamed("cls", "u"), "u", "left_semi"), sets, sim))
    twice = known.groupBy("doc_id").agg(F.min("cls").alias("u"), F.max("cls").alias("v")).where("u <> v").select("doc_id", "u")
    links = links.unionByName(known.join(twice, "doc_id").select("u", F.col("cls").alias("v")))

    label = materialize(connected_components(links))
    joined = reps.select("cls", "rep").join(label, reps["cls"] == label["node"], "left").select("cls", "rep", "component")
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("low"))
    named = joined.join(least, "component", "left").select("cls", F.coalesce("low", "rep").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    out = out.join(named, "cls", "left").select("doc_id", "n_shingles", "component_id")
    lone = nameless.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text").mapInPandas(_describe(sim, None, "tokens"), "doc_id long, n long, cls long, chk long, tokens binary")
    nothing = F.lit(None).cast("long")
    return _same_id(out).unionByName(lone.select(nothing.alias("doc_id"), F.col("n").alias("n_shingles"), nothing.alias("component_id")))


def _same_id(out: DataFrame) -> DataFrame:
    """Wordless rows are their own component, unless another row of their id has words."""
    empty = out.where("component_id IS NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles")
    full = out.where("component_id IS NOT NULL OR doc_id IS NULL")
    other = full.where("doc_id IS NOT NULL").join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return full.unionByName(empty.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one_per_group(docs: DataFrame, sim: Similarity = Similarity(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the least of their group, each once, with their own columns; of
    rows that share such an id the one with the least text stays; rows with a null id are kept as
    they are; an empty table stays empty."""
    comp = jaccard_components(docs, sim, id_col=id_col, text_col=text_col)
    comp = materialize(comp.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    once, more = (comp.where(c).select(F.col("doc_id").alias(id_col)) for c in ("rows = 1", "rows > 1"))
    kept = docs.join(_few(once), id_col, "left_semi")
    if more.limit(1).count():
        again = docs.join(_few(more), id_col, "left_semi")
        order = F.row_number().over(W.partitionBy(id_col).orderBy(text_col, F.xxhash64(*docs.columns)))
        kept = kept.unionByName(again.withColumn("_place", order).where("_place = 1").drop("_place"))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
