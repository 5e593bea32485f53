"""Jaccard join of word shingles through parity sketches.

A document's set of shingles is folded into a bit sketch: each shingle toggles
one bit, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference. Within a band of set sizes that difference is at most D for
a linked pair; the sketch has k > D words, so k - D of them agree (pigeonhole), and
documents meet on equal words. A set that shares fewer words with all others together
links with nothing; of any other its k - D - 1 most frequent words can be left out.
Words are so wide that shingles don't collide: with 64 bits the many words of one
shingle would meet by chance. What meets is verified on the sets themselves.

Equal sets are one node from the start. Within a group that shares a word not all
pairs are made: in two rounds each set meets one member of every word's group, which
connects most of it. Then sets of different components are compared by sketches with
a bit for a shingle, those of large groups in blocks of bounded size inside tasks; only pairs whose Hamming
distance allows a link leave the task and are verified. So the output is a component
for each document, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.hashing import SECOND, as_number, may_hold, membership, mixed, text_hashes, top_bytes, windows
from sedge.llm.shared import COARSE, as_text, components, looked_up, resplit, shuffle_partitions, stored, trimmed, trimmed_group

#: Sizes of a band span this factor.
BAND = 1.5
#: Sketch words that a task holds before it passes them on, and in a class: workers that pack stay for the next task.
FLUSH, CLASS = 250_000, 500_000
#: Bytes of a word's hash that travel, three bits of them for the band; the class adds some.
WIDTH, TAGS = 5, 8
#: Rounds of links to one member of each word before all that is left is compared,
#: rows of a group that are compared at once, and those of a small group.
TURNS, BLOCK, SMALL = 2, 1024, 8
#: Documents whose words a task passes on once only while it remembers them.
SEEN = 100_000
#: Scans of all texts, each under a seed of its own, before only those are scanned again whose
#: sets share a signature with another set; and such scans at most.
SEEDS, AGAIN = 1, 40


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct hashed shingles of ``n`` words, A-Z lower-cased; of a shorter text
    its whole sequence as one."""
    words = text_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else []  # of bytes, lower() changes A-Z only
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return mixed(windows(words, len(words)) + np.uint64(len(words)))
    return np.unique(windows(words, n))


def signature(s: np.ndarray, seed: int = 0, bits: int = 64) -> int:
    """The same for equal sets: ``bits`` bits of the set, not of any order; others for another seed."""
    with np.errstate(over="ignore"):
        if seed:
            s = mixed(s ^ (np.uint64(seed) * SECOND))
        total = np.array([s.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mixed(s)) + np.uint64(len(s))]) if len(s) else np.zeros(1, dtype=np.uint64)
    found = int(mixed(total).view(np.int64)[0])
    return found if bits == 64 else found & (1 << bits) - 1


class Bands:
    """Size bands for linked pairs: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        low = 1
        while self.most(low + 1) < 1:
            low += 1
        self.edges = [low]

    def most(self, top: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has less than ``top``."""
        a = top - 1
        return (100 - self.percent) * (a + a * 100 // self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """The band of size ``n``, and those below where a smaller partner may lie."""
        while self.edges[-1] <= n:
            self.edges.append(int(self.edges[-1] * BAND) + 1)
        j = int(np.searchsorted(self.edges, n, side="right")) - 1
        return [i for i in range(j + 1) if i == j or 100 * (self.edges[i + 1] - 1) >= self.percent * n]

    def words(self, s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Hashes of the sketch words on which a partner in the band can be met, and
        how many of them every partner shares at least.

        Of k words at least k - D agree. Empty words say little; they are left out
        unless there are so many that all that agree might be empty.
        """
        d = self.most(self.edges[band + 1])
        k = d + 3 + d // 4
        part = (s % np.uint64(k)).astype(np.uint16 if k < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        some = part[order][starts].astype(np.int64)
        # a word has 2**64 bits, nearly all unset; the XOR of its set bits' hashes stands for it
        sketch = np.bitwise_xor.reduceat(mixed(s[order]), starts)
        needed = len(some) - d
        if needed < 1:
            full = np.zeros(k, dtype=np.uint64)
            full[some] = sketch
            some, sketch, needed = np.arange(k), full, 1  # a partner may leave its own empty ones out
        with np.errstate(over="ignore"):
            hashes = mixed(mixed(sketch) + mixed(some.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band + 1)))
        at = np.uint64(64 - 8 * WIDTH)  # the lowest bits that travel
        return hashes & ~(np.uint64(TAGS - 1) << at) | np.uint64(band % TAGS) << at, needed


SCANNED = "doc_id string, n_shingles long, set_id long, other_id long, needed array<int>, part int, sets binary, words binary"
FIELDS = ["doc_id", "n_shingles", "set_id", "other_id", "needed", "part", "sets", "words"]


def _scan(n: int, percent: int, classes: int, seed: int, batches: Iterator[pd.DataFrame], bits: int = 64) -> Iterator[pd.DataFrame]:
    """A row for each document, and packed sketch words: a row for each flush and class.

    needed: for each band's tag how many words a partner in it shares, on the row of
    the document that gave the words. other_id: a second signature.
    """
    bands, seen = Bands(percent), set()
    ids: list[np.ndarray] = []
    words: list[np.ndarray] = []
    held = 0

    def flush() -> pd.DataFrame:
        owner, hashes = np.concatenate(ids), np.concatenate(words)
        part = (hashes % np.uint64(classes)).astype(np.uint16 if classes < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(classes + 1))
        tops = top_bytes(hashes, WIDTH)
        rows = [(None, None, None, None, None, c, owner[at].tobytes(), tops[at].tobytes()) for c in range(classes) if len(at := order[ends[c] : ends[c + 1]])]
        return pd.DataFrame(rows, columns=FIELDS)

    for batch in batches:
        sizes, own, other, needed = [], [], [], []
        for text in batch["text"]:
            s = shingles(text, n)
            sizes.append(len(s))
            own.append(signature(s, seed, bits))
            other.append(signature(s, seed + 1))
            needed.append(None)
            if len(s) < bands.edges[0] or own[-1] in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(own[-1])
            needed[-1] = [0] * TAGS
            for band in bands.of(len(s)):
                w, needed[-1][band % TAGS] = bands.words(s, band)
                ids.append(np.full(len(w), own[-1], dtype=np.int64))
                words.append(w)
                held += len(w)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "set_id": own, "other_id": other, "needed": needed, "part": None, "sets": None, "words": None})
        if held >= FLUSH:
            yield flush()
            ids, words, held = [], [], 0
    if held:
        yield flush()


def _scan_again(before: list[tuple[int, frozenset[int]]], bits: int, n: int, percent: int, classes: int, seed: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_scan`` of the texts whose sets have, for each of ``before``, one of the signatures under the seed."""

    def those() -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(text, n) for text in batch["text"]]
            some = [len(s) > 0 and all(signature(s, old, bits) in shared for old, shared in before) for s in sets]
            if any(some):
                yield batch[some]

    yield from _scan(n, percent, classes, seed, those(), bits)


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """(word, tag, sharing, set_id) for the words of a class that ``sharing`` > 1 sets share."""
    words = as_number(np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WIDTH) for w in group["words"]]))
    sets = np.concatenate([np.frombuffer(s, np.int64) for s in group["sets"]])
    order = np.lexsort((sets, words))
    words, sets = words[order], sets[order]
    new = np.r_[True, (words[1:] != words[:-1]) | (sets[1:] != sets[:-1])]
    words, sets = words[new], sets[new]
    run = np.cumsum(np.r_[False, words[1:] != words[:-1]])
    sharing = np.bincount(run)[run]
    some = sharing > 1
    words = words[some].astype(np.int64)
    return pd.DataFrame({"word": words << 16 | np.int64(group["part"].iloc[0]), "tag": words % TAGS, "sharing": sharing[some], "set_id": sets[some]})


PACKED = "part int, sets binary, words binary"


def _finer(n: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Packed rows of a class dealt into ``n`` finer ones."""
    words = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WIDTH) for w in rows["words"]])
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in rows["sets"]])
    fine = (mixed(as_number(words)) % np.uint64(n)).astype(np.int64)
    part = int(rows["part"].iloc[0])
    return pd.DataFrame([(part, int(f), sets[fine == f].tobytes(), words[fine == f].tobytes()) for f in np.unique(fine)], columns=["part", "fine", "sets", "words"])


def _by_class(packed: DataFrame, classes: int):
    """``packed`` grouped so that a group has about ``CLASS`` words, in two steps if many."""
    if classes <= COARSE:
        return packed.groupBy("part")
    return resplit(packed, PACKED, partial(_finer, -(-classes // COARSE)), FLUSH // 2).groupBy("part", "fine")


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch in words of 64 bits, about twelve bits for each shingle.

    The number of words is a power of two, so a longer sketch folds to a shorter one.
    """
    words = 1 << max(0, int(len(s) / 6).bit_length() - 1)
    counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _may_link(percent: int):
    """Whether sketches of one length differ in no more bits than a linked pair's sets
    may; those of unlike length are left to the verification."""
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda x, y: x + y)
    most = (100 - percent) * (F.col("n_shingles") + F.col("n_rep")) / (100 + percent)
    return (F.size("sketch_a") != F.size("sketch_b")) | (bits <= most)


def _close(percent: int, group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components in a word's group (or two blocks of it) whose
    sketches differ in no more bits than a linked pair's sets may."""
    n = group["n_shingles"].to_numpy()
    component, side, ids = group["component"].to_numpy(), group["side"].to_numpy(), group["set_id"].to_numpy()
    blocks = len(np.unique(side)) > 1
    raw = [np.asarray(x, dtype=np.int64).view("<u8") for x in group["sketch"]]
    lengths = np.array([len(x) for x in raw])
    by_length = {w: (np.flatnonzero(lengths >= w), folded_all(raw, lengths, w)) for w in np.unique(lengths)}
    values, counts = np.unique(component, return_counts=True)
    # every pair has a member outside the largest component
    few = np.flatnonzero(component != values[counts.argmax()])
    out = []
    for w, (rows, sketches) in by_length.items():
        at = {int(r): k for k, r in enumerate(rows)}
        for i in few:
            if int(i) not in at:
                continue
            other = component[rows] != component[i]
            # compared at the shorter one's length
            other &= (lengths[rows] == w) | (lengths[i] == w)
            other &= (rows > i) | ~np.isin(rows, few, assume_unique=True)
            if blocks:
                other &= side[rows] != side[i]
            to = np.flatnonzero(other)
            if not len(to):
                continue
            most = (100 - percent) * (n[i] + n[rows[to]]) // (100 + percent)
            bits = np.bitwise_count(sketches[to] ^ sketches[at[int(i)]]).sum(axis=1)
            near = rows[to[bits <= most]]
            out.append(np.stack([np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near])], axis=1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
    return pd.DataFrame(pairs, columns=["a", "b"])


def folded_all(raw: list[np.ndarray], lengths: np.ndarray, words: int) -> np.ndarray:
    """The sketches of at least ``words`` words, folded to that many, in order."""
    out = np.zeros((int((lengths >= words).sum()), words), dtype=np.uint64)
    where = np.flatnonzero(lengths >= words)
    for w in np.unique(lengths[where]):
        own = np.flatnonzero(lengths[where] == w)
        out[own] = folded(np.stack([raw[where[k]] for k in own]), words)
    return out


def link_sets(docs: DataFrame, sets: DataFrame, packed: DataFrame, n: int, percent: int, classes: int, bits: int = 64) -> DataFrame:
    """(node, component) of the sets that link with a different one.

    ``docs``: doc_id, text. ``sets``: set_id, seed, n_shingles, needed, copies, doc_id (of
    one document). ``packed``: part, sets, words.
    """
    shared = stored(_by_class(packed, classes).applyInPandas(trimmed_group(_meet), "word long, tag int, sharing long, set_id long"), "jaccard-shared")
    # a set has a few words for each shingle, so these windows are no longer than a text
    of_band = Window.partitionBy("set_id", "tag")
    common_first = of_band.orderBy(F.col("sharing").desc(), F.col("word").desc())
    counted = shared.withColumn("all", F.count("*").over(of_band)).withColumn("nth", F.row_number().over(common_first)).join(sets.select("set_id", "needed"), "set_id")
    at_least = F.element_at("needed", F.col("tag") + 1)
    # a partner shares at_least words, so one of those that stay
    rare = stored(counted.filter((F.col("all") >= at_least) & (F.col("nth") >= at_least)).select("word", "set_id"), "jaccard-rare")
    several = rare.groupBy("word").count().filter("count > 1").select("word")
    met = stored(rare.join(several, "word"), "jaccard-met")

    # the sets that met another, from one document of each
    wanted = stored(sets.join(met.select("set_id").distinct(), "set_id").select("doc_id", "set_id", "seed", "n_shingles"), "jaccard-wanted")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(own, s.view(np.int64), bit_sketch(s).view(np.int64)) for t, own, seed in zip(batch["text"], batch["set_id"], batch["seed"], strict=True) if signature(s := shingles(t, n), int(seed), bits) == own]
            yield pd.DataFrame(got, columns=["set_id", "items", "sketch"])

    near = may_hold(docs, "doc_id", membership(wanted, "doc_id"), "near").filter("near")
    items = stored(near.select("doc_id", "text").join(wanted.select("doc_id", "set_id", "seed"), "doc_id").select("text", "set_id", "seed").mapInPandas(trimmed(compute), "set_id long, items array<long>, sketch array<long>").dropDuplicates(["set_id"]), "jaccard-items")
    state = stored(met.join(wanted.select("set_id", "n_shingles"), "set_id").withColumn("component", F.col("set_id")), "jaccard-state")
    links, tested = None, None
    sketches = items.select("set_id", "sketch")
    a, b = (items.select(F.col("set_id").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")

    may_by_size = F.least("n_shingles", "n_rep") * 100 >= F.greatest("n_shingles", "n_rep") * percent
    one, two = (sketches.select(F.col("set_id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")

    def near_by_sketch(both: DataFrame) -> DataFrame:
        return both.join(one, "a").join(two, "b").filter(_may_link(percent)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with linked."""
        both = F.size(F.array_intersect("items_a", "items_b"))
        union = F.size("items_a") + F.size("items_b") - both
        return pairs.join(a, "a").join(b, "b").select("a", "b", (both * 100 >= union * percent).alias("linked"))

    for turn in range(TURNS + 1):
        last = turn == TURNS
        of_word = F.xxhash64("set_id", "word", F.lit(turn))
        per = state.groupBy("word").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("set_id", of_word).alias("rep"), F.count("*").alias("members"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        # words whose sets are all connected have nothing more to say
        open_words = per.filter("least < most").select("word", "rep", "members", "blocks")
        if last:
            small = state.join(per.filter(f"least < most and members <= {SMALL}").select("word"), "word").select("word", "set_id", "component", "n_shingles")
            other = small.select("word", F.col("set_id").alias("b"), F.col("component").alias("c_rep"), F.col("n_shingles").alias("n_rep"))
            both = small.withColumnRenamed("set_id", "a").join(other, "word").filter("a < b and component <> c_rep").filter(may_by_size).select("a", "b", "n_shingles", "n_rep").distinct()
            rows = state.join(open_words.filter(f"members > {SMALL}"), "word").join(sketches, "set_id").withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))
            large = rows.select("word", "one", "two", "side", "set_id", "component", "n_shingles", "sketch").groupBy("word", "one", "two").applyInPandas(lambda g: _close(percent, g), "a long, b long")
            pairs = near_by_sketch(both).union(large).distinct()
        else:
            # each word's sets against one of them, another one for another word
            open_state = state.join(open_words, "word")
            rep = state.select("word", F.col("set_id").alias("rep"), F.col("n_shingles").alias("n_rep"), F.col("component").alias("c_rep"))
            some = open_state.join(rep, ["word", "rep"]).filter("component <> c_rep").filter(may_by_size)
            both = some.select(F.least("set_id", "rep").alias("a"), F.greatest("set_id", "rep").alias("b"), "n_shingles", "n_rep").distinct()
            pairs = near_by_sketch(both)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done = stored(verified(pairs), f"jaccard-verified-{turn}")
        tested = done.select("a", "b") if tested is None else tested.union(done.select("a", "b"))
        found = done.filter("linked").select("a", "b")
        links = found if links is None else links.union(found)
        if not last:
            now = components(links).withColumnRenamed("node", "set_id")
            state = stored(state.drop("component").join(now, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), f"jaccard-state-{turn}")
    return components(links)


def number_sets(text: DataFrame, n: int, percent: int, classes: int, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, packed words) with a number, set_id, for each set.

    The number is the set's signature. Different sets that share one are told apart by a
    second signature; their texts, and no others, are scanned again under another seed until
    none share one. Among 2 * 10**10 sets about ten pairs do. Packed words of a number that
    was given up meet no set, or one more than they should, which verification takes out.
    """
    every, sets, packed, before = [], [], [], []
    seed, whole = 0, 0
    while True:
        if before:
            scan = partial(_scan_again, list(before), bits, n, percent, classes, seed)
        else:
            scan = partial(_scan, n, percent, classes, seed, **({} if bits == 64 else {"bits": bits}))
        scanned = stored(as_text(text, "doc_id").mapInPandas(trimmed(scan), SCANNED), "jaccard-scanned")
        docs = scanned.filter("part is null").select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "set_id", "other_id", "needed")
        per = docs.filter("n_shingles > 0").groupBy("set_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("needed").alias("needed"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min("other_id").alias("low"), F.max("other_id").alias("high"))
        found = stored(per.withColumn("seed", F.lit(seed)), "jaccard-sets")
        shared = found.filter("low <> high").select("set_id")
        if sets:
            shared = shared.union(found.join(sets[0].select("set_id"), "set_id", "left_semi").select("set_id"))
        shared = frozenset(r[0] for r in shared.collect())  # pairs of sets that meet in 64 bits by chance
        whole += not before
        seed += 2
        if shared and not before and whole < SEEDS:
            continue
        given_up = text.sparkSession.createDataFrame([(i,) for i in shared], "set_id long")
        if shared:
            # sets without a shingle are kept with the first scan
            docs = docs.join(F.broadcast(given_up), (docs["set_id"] == given_up["set_id"]) & (docs["n_shingles"] > 0), "left_anti")
            found = found.join(F.broadcast(given_up), "set_id", "left_anti")
        every.append(docs.select("doc_id", "n_shingles", "set_id"))
        sets = [reduce(DataFrame.union, [*sets, found.drop("low", "high")])]
        packed.append(scanned.filter("part is not null").select("part", "sets", "words"))
        if not shared:
            return reduce(DataFrame.union, every), sets[0], reduce(DataFrame.union, packed)
        before.append((seed - 2, shared))
        if len(before) > AGAIN:
            raise RuntimeError("different sets have the same signature under every seed")


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over links; two documents link
    when 100 * intersection >= ``percent`` * union of their sets of ``n``-word
    shingles. Null and empty texts have no shingles and link with nothing, so each
    is its own component. Rows that repeat an id are one node if their texts have
    equal sets; a null id is never the smallest. Empty tables give empty results; other columns
    are ignored. Sets are told apart by two signatures, of ``bits`` and of 64 bits: those that share
    the first, which serves as their number, are numbered again under another seed. Links
    are verified on 64-bit shingles.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    letters = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about six bytes to a word, and 0.3 sketch words
    classes = max(shuffle_partitions(docs.sparkSession), int(letters / 6 * 0.3 / CLASS) + 1)
    every, sets, packed = number_sets(text, n, percent, min(classes, COARSE), bits)
    linked = link_sets(text, sets, packed, n, percent, classes, bits).withColumnRenamed("node", "set_id")
    of_set = sets.join(linked, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    table = stored(of_set.join(least, "component").filter("copies > 1 or component_id <> doc_id").select("set_id", "copies", "component_id"), "jaccard-components")
    return looked_up(every, table, ["set_id"], "copies").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
