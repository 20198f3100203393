"""Near-duplicate documents by bottom-k sketches and inverted lists.

Documents with equal shingle sets form a class first. Each class keeps the k least of its shingles'
hashes, all from one hash function. Lists by retained value bring classes together; a class
enters the lists of its rarest values only, as many as two classes linked would have to share one of
(prefix filtering, by rising frequency). Classes that meet in a list overlap in their retained values; the
union's sketch estimates their resemblance, and what is above a wide margin is confirmed on full sets.

Every list goes this way, in one of two layouts: pairs of short lists are rows of a join; long lists (common
passages, groups of near copies) are cut into blocks of bounded size, whose pairs are estimated and confirmed
within a task. There, pairs that links found before already connect are passed over, so only a spanning forest
leaves the task: at most as many rows as members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.bpe import text_or_empty
from presswork.llm.common import discard, kept, map_texts, written
from presswork.llm.components import components

WORDS, PERCENT = 5, 85
#: Values kept of a class, the chance of missing a link right at the threshold, the length up to which lists
#: are joined pair by pair, and members of a block of longer ones.
SKETCH, MISS, SHORT, BLOCK = 32, 1e-6, 32, 1_024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD_HASHES = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def common(percent: int) -> float:
    """The share of the sketch that the two of a link have at least in common: the largest that a link
    right at the threshold stays below with a chance of at most ``MISS`` (85: 16 of 32, 80: 13 of 32)."""
    p, below, k = percent / 100, 0.0, 0
    while k < SKETCH and (below := below + comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) <= MISS:
        k += 1
    return k / SKETCH


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh64_digest(word)
        if len(self) < _WORD_HASHES:
            self[word] = h
        return h


_hashes = _Hashes()
kept["minhash"] = _hashes.clear


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct shingles; one of all words if they are fewer; or none."""
    w = np.frombuffer(b"".join(map(_hashes.__getitem__, text.encode("utf-8", "replace").translate(_LOWER).split())), "<u8")
    if not len(w):
        return np.zeros(0, np.int64)
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h ^= w[j : j + n]
        h *= _MIX
        h ^= h >> np.uint64(31)
    return np.unique((h >> np.uint64(1)).view(np.int64))


def _set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, place, n, set_id, sketch) of (doc_id, text, place) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, kept = [], [], []
            for text in text_or_empty(batch):
                s = shingle_set(text, words)
                n.append(len(s))
                ids.append(_set_id(s))
                kept.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "place", "n", "set_id", "sketch"])
        _hashes.clear()

    return map_texts(docs, run, "doc_id long, place long, n long, set_id binary, sketch array<long>", "minhash")


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(set_id, s) of (doc_id, text) rows, one row a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_or_empty(batch)
            for at in range(0, len(texts), 200):
                sets = [shingle_set(t, words) for t in texts[at : at + 200]]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "s"])
        _hashes.clear()

    return map_texts(docs, run, "set_id binary, s array<long>", "minhash")


def _overlaps(kept: list[np.ndarray]) -> np.ndarray:
    """How many retained values any two members share, as a matrix."""
    n = len(kept)
    owner = np.repeat(np.arange(n), [len(k) for k in kept])
    column = np.unique(np.concatenate(kept), return_inverse=True)[1]
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2_048):
        a, b = np.searchsorted(column, [at, at + 2_048])
        part = np.zeros((n, 2_048), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


_NO_VALUE = np.iinfo(np.int64).max


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Resemblance of the sketch ``one`` with each of ``others`` (rows, filled up with ``_NO_VALUE``): the part
    of the union's sketch that is in both."""
    both = np.sort(np.concatenate([others, np.broadcast_to(one, (len(others), len(one)))], axis=1), axis=1)
    real = both != _NO_VALUE
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    return (again & (rank <= SKETCH)).sum(1) / np.minimum(rank[:, -1], SKETCH)


def forest(ids: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Edges of a spanning forest of the exact links among a block's members."""
    n, least = len(ids), common(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    kept = [s[:SKETCH] for s in sets]
    sketch = np.full((n, SKETCH), _NO_VALUE)
    for row, k in zip(sketch, kept, strict=True):
        row[: len(k)] = k
    overlap, held = _overlaps(kept), np.minimum(sizes, SKETCH)
    whole, ends = np.concatenate(sets), np.cumsum(sizes)
    left, out = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            at = todo.pop()
            # a part of the sketches' overlap is in the union's sketch, so this loses nothing that the estimate keeps
            near = np.flatnonzero(left & (overlap[at] >= least * np.maximum(held, held[at])))
            near = near[100 * np.minimum(sizes[near], sizes[at]) >= percent * np.maximum(sizes[near], sizes[at])]
            for k in range(0, len(near), 256):
                some = near[k : k + 256]
                some = some[estimates(sketch[at], sketch[some]) >= least]
                if not len(some):
                    continue
                values = np.concatenate([whole[ends[x] - sizes[x] : ends[x]] for x in some])
                place = np.minimum(np.searchsorted(sets[at], values), sizes[at] - 1)
                inter = np.add.reduceat((sets[at][place] == values).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                new = some[100 * inter >= percent * (sizes[some] + sizes[at] - inter)]
                left[new] = False
                out += [(ids[at], ids[x]) for x in new]
                todo += new.tolist()
    return out


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links between classes that connect all that the full set of links connects; and the written tables
    that they are made from. A class's text is that of its ``first`` (doc_id, place)."""
    least = common(percent)
    values = classes.select("set_id", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = values.join(often, "v").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("met"))
    # a linked class shares at least ``least`` of the values, so one of the rarest (1 - least) and one more
    room = F.size("sketch") - F.ceil(F.size("sketch") * least) + 1 - (F.size("sketch") - F.size("met"))
    rare = classes.join(met, "set_id").withColumn("met", F.slice("met", 1, F.greatest(room, F.lit(0)).cast("int")))
    entries = written(rare.select("set_id", "first", "n", "sketch", F.explode("met").alias("e")).select("set_id", "first", "n", "sketch", "e.v", "e.c"), "entries")

    short = entries.where(F.col("c") <= SHORT)
    left, right = (short.select("v", *[F.col(x).alias(f"{side}_{x}") for x in ("set_id", "first", "n", "sketch")]) for side in "ab")
    near = (F.col("a_set_id") < F.col("b_set_id")) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    union = F.slice(F.sort_array(F.array_union("a_sketch", "b_sketch")), 1, SKETCH)
    resemblance = F.size(F.array_intersect(union, F.array_intersect("a_sketch", "b_sketch"))) / F.size(union)
    pairs = left.join(right, "v").where(near).where(resemblance >= least)
    pairs = written(pairs.select("a_set_id", "b_set_id", "a_first", "b_first", "a_n", "b_n").distinct(), "pairs")

    long = entries.where(F.col("c") > SHORT).select("v", "c", "set_id", "first")
    wanted = pairs.select(F.col("a_first").alias("f")).unionByName(pairs.select(F.col("b_first").alias("f"))).unionByName(long.select(F.col("first").alias("f")))
    # the written list's size decides whether it is broadcast, so it holds little: a text's hash only where it has no id;
    # a repeated id may bring other texts along: harmless
    nameless = lambda t: F.when(t["doc_id"].isNull(), t["place"]).otherwise(0)
    wanted = written(wanted.select("f.doc_id", nameless(F.col("f")).alias("place")).distinct(), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (nameless(texts) == wanted["place"]), "left_semi")
    made = written(full_sets(texts.select("doc_id", "text"), words), "sets")
    discard(wanted)
    sets = made.dropDuplicates(["set_id"])
    side = lambda x: sets.select(F.col("set_id").alias(f"{x}_set_id"), F.col("s").alias(f"{x}_s"))
    inter = F.size(F.array_intersect("a_s", "b_s"))
    sure = pairs.join(side("a"), "a_set_id").join(side("b"), "b_set_id").where(100 * inter >= percent * (F.col("a_n") + F.col("b_n") - inter))

    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = long.withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("set_id"), "k").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    dealt = mine.withColumn("cell", F.explode(cells)).select("v", "cell.i", "cell.j", "set_id").join(sets, "set_id")

    def found(members: pa.Table) -> pa.Table:
        got = members.combine_chunks()
        edges = forest(got.column("set_id").to_pylist(), [np.asarray(x.values) for x in got.column("s")], percent)
        return pa.table([pa.array([a for a, _ in edges], pa.binary()), pa.array([b for _, b in edges], pa.binary())], names=["a", "b"])

    hot = dealt.groupBy("v", "i", "j").applyInArrow(found, "a binary, b binary")
    return sure.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b")).unionByName(hot), [entries, pairs, made]


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, place, n, set_id, component_id, keeper) of (doc_id, text) rows: ``place`` tells apart the texts
    of an id, ``component_id`` is the least id of the row's group, and ``keeper`` the (doc_id, place) that stays
    of the group, null for rows without words. Of rows with null ids one stays if the group has no other."""
    rows = docs.withColumn("place", F.xxhash64("text"))
    base = written(sketches(rows, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place"))
    classes = base.where("n > 0").groupBy("set_id").agg(first.alias("first"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = written(classes, "classes")
    edges, used = links(docs, classes, words, percent)
    roots = components(edges).select(F.col("a").alias("set_id"), F.col("b").alias("root"))
    discard(*used)
    named = classes.select("set_id", "first").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = named.join(named.groupBy("root").agg(F.min("first").alias("keeper")), "root").select("set_id", "keeper")
    out = base.drop("sketch").join(names, "set_id", "left")
    return out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("keeper.doc_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document.

    Links are 100 * intersection >= percent * union of whole shingle sets. Null text is empty; a
    document without words is linked with nothing. Repeated ids give repeated rows; a null id is no
    name for a component: its own row has the least id of its group, is kept only if it has no
    such, and an empty table gives no rows. Other columns are not read."""
    out = _grouped(_two(docs, key, text), words, percent)
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _two(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of each group of near duplicates one row.

    A row is judged by its own text, never by its id alone: texts that share an id but are no near duplicates all
    stay. The one that stays has the group's least id (null ids come last); rows with equal id and text are
    copies of one document, of which the one that is least as JSON stays. Rows without words all stay."""
    found = _grouped(_two(docs, key, text), words, percent)
    mine = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    goes = (F.col("n") > 0) & (mine != F.col("keeper"))
    judged = written(found.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("copies"), F.first(F.coalesce(goes, F.lit(False))).alias("goes"), F.first(F.col("n") > 0).alias("solid")), "judged")
    ids = judged.groupBy("doc_id").agg((F.sum("copies") == 1).alias("once"), F.first("goes").alias("goes"))
    # an id that stands for one row needs no more than itself to be listed
    gone = written(ids.where("once and goes and doc_id is not null").select("doc_id"), "gone")
    several = ids.where("not once or doc_id is null").select(F.col("doc_id").alias("id"))
    odd = judged.where("solid and (goes or copies > 1)")
    odd = written(odd.join(several, odd["doc_id"].eqNullSafe(several["id"]), "left_semi").select("doc_id", "place", "goes"), "odd")
    whole = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("place"))
    stay = whole.join(gone, "doc_id", "left_anti")
    if odd.isEmpty():
        return stay.select("row.*")
    same = lambda t: stay["doc_id"].eqNullSafe(t["doc_id"]) & (stay["place"] == t["place"])
    copies = stay.join(odd.where("not goes"), same(odd), "left_semi").groupBy("doc_id", "place").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stay.join(odd, same(odd), "left_anti").select("row.*").unionByName(copies.select("row.*"))
