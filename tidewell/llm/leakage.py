"""Evaluation texts inside training texts (problem 9): greedy string tiling.

First the items are looked at by themselves: passages that are equal, or near copies of each other, are one family, and
phrases that several families share are stock.  Then every document is scanned once, against one block of test items after
another; a block's seeds (word n-grams) are an index of proven size, of which a worker holds one at a time.  A seed is as
short as a tile may be, so the words in shared seeds, joined
over single other words as tiles are, bound from above how much of an item tiling can cover; pairs whose bound is too low
end there, and none of them is a case.  The rest are tiled: longest common stretches first, by running
Karp-Rabin over word ids, each word marked once on either side, until no match of ``least`` words is left.  Tiles that a single
altered, added or missing word parts are one stretch; stretches under ``stretch`` words are phrases and don't count.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.distinct import as_strings
from tidewell.session import scratch, spread

_DROP = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_LETTER = re.compile(r"[^\W\x00-\x7f]")
_MARKED = re.compile(r"[^\w\s]|_")


@dataclass(frozen=True)
class LeakRules:
    """share: of an item's words that must stand in the document; seed: words of a phrase that can be stock; least: words
    of the shortest tile, and of the seeds that lead to pairs; stretch: words of the shortest stretch that counts; stock:
    a phrase that this many families of items have is a stock phrase, and at least half of the share must come from
    stretches outside of stock phrases, unless ``whole`` of the item is there; alike: share of the seeds of the shorter of two
    passages that both have from which on they are one family; block, block_chars: items and characters in one index, which bound
    it; pairs: places of shared seeds that are looked at together, and chunk: characters of documents held while the blocks
    take turns, which bound the memory of a scan."""

    share: float = 0.4
    seed: int = 5
    least: int = 3
    stretch: int = 10
    stock: int = 3
    whole: float = 0.8
    alike: float = 0.8
    block: int = 2000
    block_chars: int = 8_000_000
    pairs: int = 1_000_000
    chunk: int = 16_000_000


def normal_words(text: str) -> list[bytes] | list[str]:
    """Words without case, accents and punctuation: what stands between white space, less everything but letters and digits."""
    flat = unicodedata.normalize("NFKD", text.casefold())
    if not _LETTER.search(flat):
        return flat.encode("ascii", "ignore").translate(None, _DROP).split()
    return [w.encode() for w in _MARKED.sub("", "".join(c for c in flat if not unicodedata.combining(c))).split()]


class SeedIndex:
    """Seeds of a block of items, as sorted arrays: the word ids of all items in a row, and n-grams of ids to places.

    items: names and normal words; stock: for each, the places where a stock phrase of ``rules.seed`` words begins."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rules: LeakRules, stock: list[list[int]] | None = None):
        self.rules, self.names = rules, [i for i, _ in items]
        words = [w for _, w in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.ids = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]
        self.lengths = np.array([len(x) for x in self.ids], np.int64)
        self.start = np.r_[0, np.cumsum(self.lengths)]
        self.keys, self.places, self.owners = self._grams(rules.least)
        self.unique, self.first, self.count = np.unique(self.keys, return_index=True, return_counts=True)
        self.stock = np.zeros(self.start[-1], bool)
        for start, places in zip(self.start, stock or []):
            for at in places:
                self.stock[start + at : start + at + rules.seed] = True

    def _grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every n words of the items, by hash: (hash, place, item)."""
        keys, places, owners = [], [], []
        for i, x in enumerate(self.ids):
            if len(x) >= n:
                keys.append(ngrams(x, n))
                places.append(np.arange(len(x) - n + 1) + self.start[i])
                owners.append(np.full(len(x) - n + 1, i))
        k, p, o = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (places, np.int64), (owners, np.int64)))
        order = np.argsort(k, kind="stable")
        return k[order], p[order], o[order]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[int, int, np.ndarray]]:
        """(text, item, ids of the text) of the pairs that tiling can bring to the share; texts as normal words."""
        n, get = self.rules.least, self.vocabulary.get
        out: list[tuple[int, int, np.ndarray]] = []
        if not len(self.unique):
            return out
        ids = [np.array([get(w, 0) for w in t], np.int64) for t in texts]
        sizes = np.array([len(x) + 1 for x in ids])
        flat = np.zeros(int(sizes.sum()), np.int64)  # a zero, which no seed has, parts the texts
        offset = np.r_[0, np.cumsum(sizes)]
        for x, o in zip(ids, offset):
            flat[o : o + len(x)] = x
        if len(flat) < n:
            return out
        known = np.convolve(flat != 0, np.ones(n, np.int64), "valid") == n
        at = np.flatnonzero(known)
        if not len(at):
            return out
        grams = ngrams(flat, n)[at]
        slot = np.searchsorted(self.unique, grams)
        hit = (slot < len(self.unique)) & (self.unique[np.minimum(slot, len(self.unique) - 1)] == grams)
        at, slot = at[hit], slot[hit]
        if not len(at):
            return out
        document = np.searchsorted(offset, at, side="right") - 1
        pair = np.unique(np.stack([document, slot], 1), axis=0)
        reps = self.count[pair[:, 1]]
        # whole texts at a time, up to some number of places
        part = (np.cumsum(reps) - reps)[np.searchsorted(pair[:, 0], pair[:, 0])] // self.rules.pairs
        for few in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(part)) + 1):
            out += [(d, item, ids[d]) for d, item in self._reach(pair[few], reps[few])]
        return out

    def _reach(self, pair: np.ndarray, reps: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of the pairs whose bound reaches the share.

        Words of tiles lie in seeds, and those of one stretch have at most one other word between them in the item.
        So the item's words in seeds, joined over single words and without what joins to less than a stretch, hold all
        that tiling can mark."""
        n, rules = self.rules.least, self.rules
        spread = np.repeat(self.first[pair[:, 1]], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        d, item, place = np.repeat(pair[:, 0], reps), self.owners[spread], self.places[spread]
        order = np.lexsort((place, d * len(self.ids) + item))
        d, item, place = d[order], item[order], place[order]
        same = np.r_[(np.diff(d) == 0) & (np.diff(item) == 0), False]
        gap = np.r_[np.diff(place), 0]
        joined = same & (gap <= n + 1)
        begins = np.flatnonzero(np.r_[True, ~joined[:-1]])
        words = np.add.reduceat(np.where(joined, np.minimum(n, gap), n), begins)
        words[words < rules.stretch] = 0
        first = np.flatnonzero(np.r_[True, ~same[:-1]])
        covered = np.add.reduceat(words, np.searchsorted(begins, first))
        good = first[covered >= rules.share * self.lengths[item[first]] - 1e-9]
        return [(int(a), int(b)) for a, b in zip(d[good], item[good])]

    def coverage(self, item: int, text: np.ndarray) -> tuple[float, float]:
        """Shares of the item's words in stretches of the text: of all, and of those outside of stock phrases."""
        marked = tile(self.ids[item], text, self.rules.least, self.rules.stretch)
        n = max(1, self.lengths[item])
        stock = self.stock[self.start[item] : self.start[item + 1]]
        return float(marked.sum() / n), float((marked & ~stock).sum() / n)

    def cases(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float]]:
        """(text, item name, coverage) of the pairs that are cases."""
        rules = self.rules
        for d, item, ids in self.scan(texts):
            share, own = self.coverage(item, ids)
            if share >= rules.share and (own >= rules.share / 2 or share >= rules.whole):
                yield d, self.names[item], share


def ngrams(ids: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of every n ids; 64 bits, and matches are confirmed by tiling."""
    x = ids.astype(np.uint64)
    h = np.zeros(len(x) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k] * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


def matches(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common stretches of at least n ids: (length, place in a, place in b); zeros match nothing."""
    if len(a) < n or len(b) < n:
        return []
    ha, hb = ngrams(a, n), ngrams(b, n)
    order = np.argsort(ha, kind="stable")
    low, high = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return []
    reps = (high - low)[found]
    j = np.repeat(found, reps)
    i = order[np.repeat(low[found], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))]
    sure = np.ones(len(i), bool)
    for k in range(n):
        sure &= (a[i + k] == b[j + k]) & (a[i + k] != 0)
    i, j = i[sure], j[sure]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)]) if len(i) else np.empty(0, int)
    ends = np.r_[start[1:], len(i)]
    return [(int(e - s) + n - 1, int(i[s]), int(j[s])) for s, e in zip(start, ends)]


def tile(item: np.ndarray, text: np.ndarray, least: int, stretch: int) -> np.ndarray:
    """Which words of the item lie in stretches of the text, by greedy string tiling."""
    import heapq

    queue = [(-n, i, j) for n, i, j in matches(item, text, least)]
    heapq.heapify(queue)
    used_i, used_j = bytearray(len(item)), bytearray(len(text))
    tiles: list[tuple[int, int, int]] = []
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        if 1 not in used_i[i : i + n] and 1 not in used_j[j : j + n]:
            used_i[i : i + n] = used_j[j : j + n] = b"\1" * n
            tiles.append((i, j, n))
            continue
        # partly marked: what is left of it goes back in line
        free = 0
        for k in range(n + 1):
            if k < n and not used_i[i + k] and not used_j[j + k]:
                free += 1
            else:
                if free >= least:
                    heapq.heappush(queue, (-free, i + k - free, j + k - free))
                free = 0
    tiles.sort()
    marked = np.zeros(len(item), bool)
    k = 0
    while k < len(tiles):
        m = k
        words = tiles[k][2]
        while m + 1 < len(tiles):
            (i, j, n), (p, q, _) = tiles[m], tiles[m + 1]
            if not (0 <= p - i - n <= 1 and 0 <= q - j - n <= 1):
                break
            m += 1
            words += tiles[m][2]
        if words >= stretch:
            for i, _, n in tiles[k : m + 1]:
                marked[i : i + n] = True
        k = m + 1
    return marked


def _scan(indexes: list, key_type: pa.DataType, chunk: int):
    """One pass over the documents.  With several blocks, documents are held up to ``chunk`` characters while each index
    is loaded from the worker's disk, used and let go."""
    schema = pa.schema([("item_id", pa.int64()), ("doc", key_type), ("coverage", pa.float64())])
    step = 256

    def found(keys: list, words: list[list[bytes]]) -> list[tuple]:
        rows = []
        for index in indexes:
            seeds: SeedIndex = index.value
            for i in range(0, len(words), step):
                rows += [(name, keys[i + d], share) for d, name, share in seeds.cases(words[i : i + step])]
            if len(indexes) > 1:
                del seeds
                index.__dict__.pop("_value", None)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        keys, words, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), as_strings(batch.column(1))):
                keys.append(k)
                words.append(normal_words(t))
                size += len(t)
                if size >= chunk or (len(indexes) == 1 and len(keys) == step):
                    if rows := found(keys, words):
                        yield batch_of(rows)
                    keys, words, size = [], [], 0
        if keys and (rows := found(keys, words)):
            yield batch_of(rows)

    return run


_BANDS, _ROWS = 16, 4


def _prepared(seed: int):
    """Items as normal words, with a hash of these, the hashes of their seeds in order, and bands of a min-hash of them."""
    names = ["i", "h", "words", "seeds", "bands"]
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, _BANDS * _ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), as_strings(batch.column(1))):
                words = normal_words(t)
                line = b" ".join(words)
                seeds = np.array([int.from_bytes(hashlib.blake2b(b" ".join(words[k : k + seed]), digest_size=8).digest(), "little") for k in range(len(words) - seed + 1)], np.uint64)
                bands = []
                if len(seeds):
                    with np.errstate(over="ignore"):
                        mixed = seeds[:, None] * factors
                        lowest = (mixed ^ (mixed >> np.uint64(32))).min(0).reshape(_BANDS, _ROWS)
                    bands = [int.from_bytes(hashlib.blake2b(bytes([k]) + x.tobytes(), digest_size=8).digest(), "little", signed=True) for k, x in enumerate(lowest)]
                rows.append((i, hashlib.blake2b(line, digest_size=16).hexdigest(), line, seeds.view(np.int64).tolist(), bands))
            types = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, types)], names=names)

    return run


def families(passages: DataFrame, alike: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """h, family of distinct passages (h, seeds, bands): those that share a band with the first passage of the band and
    ``alike`` of the seeds of the shorter of the two are one family, named by its smallest h.

    Each passage meets at most one other for each band, so nothing is paired with all of its like; names then run along
    four of these links."""
    bands = passages.select(F.explode("bands").alias("band"), "h")
    first = bands.groupBy("band").agg(F.min("h").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    links = bands.join(first, "band").where("h <> first").select("h", "first").distinct()
    seeds = lambda name: passages.select(F.col("h").alias(name), F.array_distinct("seeds").alias(f"{name}_seeds"))
    both = links.join(seeds("h"), "h").join(seeds("first"), "first")
    common = F.size(F.array_intersect("h_seeds", "first_seeds"))
    sure = keep(both.where(common >= alike * F.least(F.size("h_seeds"), F.size("first_seeds"))).groupBy("h").agg(F.min("first").alias("to")))
    out = passages.select("h", F.col("h").alias("family"))
    for _ in range(0 if sure.isEmpty() else 4):
        out = out.join(sure.select(F.col("h").alias("family"), "to"), "family", "left").select("h", F.coalesce("to", "family").alias("family"))
    return out


def prepared_items(items: DataFrame, keep: Callable[[DataFrame], DataFrame], item: str = "item_id", passage: str = "passage", rules: LeakRules | None = None) -> DataFrame:
    """i, words (normal, joined by blanks), stock: each distinct item with the places where stock phrases begin in it.

    Phrases are counted over the whole table, once for each family of passages, so neither the order nor the number of
    items in a scan changes what is stock, and a passage isn't stock because it was issued several times.  ``keep`` writes what
    is read several times."""
    rules = rules or LeakRules()
    texts = items.where(F.col(passage).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(passage).alias("t")).distinct()
    ready = keep(texts.mapInArrow(_prepared(rules.seed), "i long, h string, words binary, seeds array<long>, bands array<long>"))
    passages = ready.groupBy("h").agg(F.first("seeds").alias("seeds"), F.first("bands").alias("bands"))
    phrases = passages.select("h", F.explode(F.array_distinct("seeds")).alias("s")).join(families(passages, rules.alike, keep), "h").select("family", "s").distinct()
    stock = phrases.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= rules.stock).select("s")
    places = passages.select("h", F.posexplode("seeds").alias("at", "s")).join(stock, "s").groupBy("h").agg(F.array_sort(F.collect_list("at")).alias("stock"))
    return ready.select("i", "h", "words").join(places, "h", "left").select("i", "words", F.coalesce("stock", F.array().cast("array<int>")).alias("stock"))


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", rules: LeakRules | None = None) -> DataFrame:
    """item, key, coverage: documents with the items that leaked into them, and the share of the item's words found.

    The items are a stated set against all documents: they are read in blocks of ``rules.block`` items or
    ``rules.block_chars`` characters, each of which makes one index (some ten bytes a character).  Documents are read once,
    where they lie, without a shuffle, whatever the number of blocks; a worker holds one index at a time.  Equal and
    near-equal items are each reported; copies of documents are each reported.  Null or blank texts and passages, and
    passages shorter than a stretch, match nothing; repeated items are one.  Keys may be null; extra columns are ignored."""
    from pyspark.sql.pandas.types import to_arrow_type

    rules = rules or LeakRules()
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    source = spread(docs.where(F.col(text).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(key), F.col(text)))
    indexes: list = []
    block: list[tuple[int, list[bytes]]] = []
    stock: list[list[int]] = []
    size = 0

    def close() -> None:
        indexes.append(spark.sparkContext.broadcast(SeedIndex(block, rules, stock)))

    with scratch(spark) as keep:
        for row in prepared_items(items, keep, item, passage, rules).orderBy("i", "words").toLocalIterator():
            words = bytes(row["words"])
            block.append((row["i"], words.split()))
            stock.append(list(row["stock"]))
            size += len(words)
            if len(block) == rules.block or size >= rules.block_chars:
                close()
                block, stock, size = [], [], 0
    if block or not indexes:
        close()
    out = source.mapInArrow(_scan(indexes, to_arrow_type(kind), rules.chunk), f"item_id long, doc {kind.simpleString()}, coverage double")
    return out.groupBy("item_id", "doc").agg(F.max("coverage").alias("coverage")).select(F.col("item_id").alias(item), F.col("doc").alias(key), "coverage")
