"""Language-model scoring with a probabilistic suffix tree over words.

Every count is taken over all training documents. Three steps read the corpus:

1. word counts, summed by word hash (they give the base score and the head: words with a share of ``p_symbol`` or
   more, at most ``1 / p_symbol`` of them, which is what bounds the broadcast);
2. each text becomes its symbols (a head word's number, 0 for any other word, 1 for the end) and the hashes of its
   other words, written once without the text;
3. for each context length up to ``depth``, counts of (context, next symbol) for every context with a share of ``p_context``:
   the tree's trunk, which is sent to the tasks;
4. counts of (word, next symbol) for all other head words that occur ``least`` times: the tree's leaves. All their pairs that
   occur twice are kept, as a table that grows with the corpus and meets the texts by a join.

A context of the trunk stays if its next-symbol counts diverge from those of its suffix: the G statistic over next symbols that
are expected five times or more, the rest as one class, beyond ``z`` standard deviations. A leaf stays if one next symbol is so
much more frequent than expected that the Poisson bound of that excess is below ``RARE``. Next-symbol distributions
are smoothed towards the longest kept suffix's by Witten-Bell weights; in the trunk, next symbols below ``p_symbol`` of all
tokens share the suffix's. A token's state is the longest kept context that ends before it. Words beyond the head are
scored as symbol 0 times their share among such words, by a join with their counts, not by a broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, scratch_mark, text_of

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: White space is never part of a word, so this is no word's hash input.
END_WORD = b"\n"
OTHER, END, FIRST = 0, 1, 2  # symbol numbers
HELD_OUT_OF = 10
#: Next symbols that a task sorts at once; it sends its counts on when they exceed twice as many keys.
COUNTED = 500_000
#: A leaf needs a next symbol whose excess is less likely than this, which leaves room for a million symbols.
RARE = 1e-9


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


END_HASH = word_hash(END_WORD)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, mod 10, is 0. A null id counts as the empty text, so it is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


def _longs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = _longs(np.fromiter(map(word_hash, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not is_held_out(doc_id):
                counts.update(words_of(text))
                counts[END_WORD] += 1
        if len(counts) > most:
            yield flush()
    if counts:
        yield flush()


class _Symbols(dict):
    """Word to symbol number; other words get -1 and down, places in ``others``."""

    def __init__(self, head: np.ndarray):
        super().__init__()
        self.head, self.others = {h: i + FIRST for i, h in enumerate(head.tolist())}, []

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        if (s := self.head.get(h)) is None:
            self.others.append(h)
            s = -len(self.others)
        self[word] = s
        return s


def _encode(head, most: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = None
        for batch in batches:
            if symbols is None or len(symbols) > most:
                symbols = _Symbols(head.value)
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                s = np.fromiter(map(symbols.__getitem__, words), np.int32, len(words))
                others = -1 - s[s < 0]
                for column, value in zip(out, (is_held_out(doc_id), len(words) + 1, np.append(np.maximum(s, OTHER), END).astype(np.int32).tobytes(), [symbols.others[i] for i in others.tolist()]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_tokens", "symbols", "others"])

    return run


class Tree:
    """The kept contexts. ``levels[d]`` has, for contexts of d + 1 symbols: find (sorted keys of context of d symbols and the
    symbol before it, with their numbers), kept, total (n), low (weight of the suffix), entries (sorted keys of context and
    next symbol) and counts."""

    def __init__(self, unigram: np.ndarray):
        self.unigram, self.levels = unigram, []
        #: By symbol: the number of the context of that symbol alone, or -1.
        self.first = np.full(len(unigram), -1, np.int32)
        #: By symbol: how often a leaf is followed and its weight of the suffix; 0 where the symbol is no kept leaf.
        self.leaf_total = self.leaf_low = np.zeros(len(unigram))

    def contexts(self, s: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """For each level, the number of the context before each symbol, or -1. ``s`` starts with an end as the context of
        its first symbol and has no position for it."""
        n = len(s) - 1
        for d, level in enumerate(self.levels[:depth]):
            if d == 0:
                at = self.first[s[:n]].astype(np.int64)
                yield at
                continue
            out = np.full(n, -1, np.int64)
            j = np.flatnonzero(at[d:] >= 0)
            if len(j) and len(level["find"]):
                keys = (at[j + d] << 32) | s[j]
                i = np.minimum(np.searchsorted(level["find"], keys), len(level["find"]) - 1)
                out[j + d] = np.where(level["find"][i] == keys, level["number"][i], -1)
            yield out
            at = out

    def log10(self, s: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability in its longest kept state."""
        nxt = s[1:].astype(np.int64)
        p = self.unigram[nxt]
        leaf = np.flatnonzero(self.leaf_total[s[:-1]])
        p[leaf] *= self.leaf_low[s[leaf]] / self.leaf_total[s[leaf]]  # pairs of the leaves' table are added by a join
        for level, at in zip(self.levels, self.contexts(s, len(self.levels)), strict=True):
            i = np.flatnonzero((at >= 0) & level["kept"][at])
            if not len(i):
                continue
            c = at[i]
            keys, n = (c << 32) | nxt[i], np.zeros(len(i))
            if len(level["entries"]):
                j = np.minimum(np.searchsorted(level["entries"], keys), len(level["entries"]) - 1)
                n = np.where(level["entries"][j] == keys, level["counts"][j], 0)
            p[i] = (n + level["low"][c] * p[i]) / level["total"][c]
        return np.log10(p)


def leaf_keys(leaf: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(symbol, next symbol) wherever ``leaf`` has the symbol."""
    i = np.flatnonzero(leaf[s[:-1]])
    return (s[i].astype(np.int64) << 32) | s[i + 1]


def _with_start(raw: bytes) -> np.ndarray:
    return np.concatenate([[END], np.frombuffer(raw, np.int32)])


def _count_next(keys_of):
    """Counts of the keys (context, next symbol) that ``keys_of`` finds in a text's symbols, merged within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []  # sorted runs of different keys, with their counts
        counts: list[np.ndarray] = []
        found: list[np.ndarray] = []
        size = 0

        def sort_found() -> None:
            nonlocal found, size
            k, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            keys.append(k)
            counts.append(n)
            found, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)

        for batch in batches:
            for raw in batch.column(0):
                s = _with_start(raw.as_py())
                found.append(keys_of(s))
                size += len(found[-1])
                if size > COUNTED:
                    sort_found()
                    if sum(map(len, keys)) > 4 * COUNTED:
                        k, n = merged()
                        keys, counts = [k], [n]
                        if len(k) > 2 * COUNTED:
                            yield _longs(k, n)
                            keys, counts = [], []
        sort_found()
        yield _longs(*merged())

    return run


def _count_contexts(tree, depth: int):
    def keys_of(s: np.ndarray) -> np.ndarray:
        *_, at = tree.value.contexts(s, depth)
        i = np.flatnonzero(at >= 0)
        return (at[i] << 32) | s[1:][i]

    return _count_next(keys_of)


def _leaf_pairs(tree):
    """(rid, key, n): the pairs of each text that begin with a kept leaf, sent on before they exceed ``COUNTED`` by much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["rid", "key", "n"])
            found.clear()
            return out

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k, n = np.unique(leaf_keys(tree.value.leaf_total, _with_start(raw.as_py())), return_counts=True)
                found.append((np.full(len(k), i), k, n))
                size += len(k)
                if size > COUNTED:
                    yield flush()
                    size = 0
        if found:
            yield flush()

    return run


def _excess(unigram, counts):
    """(c, n, most): each pair's count and the exponent of its excess's Poisson bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, o = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            c, x = key >> 32, key & 0xFFFFFFFF
            e = counts.value[c] * unigram.value[x]
            most = np.where(o > e, o * np.log(o / e) - o + e, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(o, pa.int64()), pa.array(most, pa.float64())], names=["c", "n", "most"])

    return run


def _delta(tree):
    """(key, delta): what log10 of a stored pair's probability gains over a pair that isn't stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            key, n = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            key, n = (v[t.leaf_total[key >> 32] > 0] for v in (key, n))
            gain = np.log10(1 + n / (t.leaf_low[key >> 32] * t.unigram[key & 0xFFFFFFFF]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(gain, pa.float64())], names=["key", "delta"])

    return run


def grow_leaves(tree: Tree, coded: DataFrame, n_symbol: np.ndarray, total: int, p_context: float, least: int) -> DataFrame:
    """Find the tree's leaves and return their pairs (key, n) that occur twice or more in training texts. A leaf is a head word
    below the trunk's share that occurs ``least`` times: at most ``1 / p_symbol`` numbers for the driver and the tasks, while the
    pairs stay a table."""
    spark = coded.sparkSession
    able = (n_symbol >= least) & (n_symbol < max(p_context * total, 1.0))
    able[: END + 1] = False
    sent = spark.sparkContext.broadcast(able)
    pairs = coded.where(~F.col("held_out")).select("symbols").mapInArrow(_count_next(lambda s: leaf_keys(sent.value, s)), "key long, n long")
    pairs = materialise(pairs.groupBy("key").agg(F.sum("n").alias("n")), "lm-leaf-pairs")
    unigram, counts = spark.sparkContext.broadcast(tree.unigram), spark.sparkContext.broadcast(n_symbol)
    each = pairs.mapInArrow(_excess(unigram, counts), "c long, n long, most double")
    found = each.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("stored"), F.max("most").alias("most"))
    found = found.where(F.col("most") > -np.log(RARE)).select("c", "k", "n", "stored").toPandas()
    c, k, n, stored = (found[x].to_numpy(np.int64) for x in ("c", "k", "n", "stored"))
    tree.leaf_total, tree.leaf_low = np.zeros(len(n_symbol)), np.zeros(len(n_symbol))
    tree.leaf_total[c], tree.leaf_low[c] = n + k, n - stored + k
    return pairs.where("n > 1")


def _score(tree, base_log10):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, known, model = [], [], []
            for raw in batch.column(4).to_pylist():
                s = _with_start(raw)
                inner = s[1:][s[1:] != OTHER]
                base.append(float(base_log10.value[inner].sum()))
                known.append(int(len(inner) if len(base_log10.value) > END and tree.value.trained else 0))
                model.append(float(tree.value.log10(s).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(base, pa.float64()), pa.array(known, pa.int64()), pa.array(model, pa.float64())], names=["rid", "doc_id", "held_out", "n_tokens", "base", "known", "model"])

    return run


def _level(found: dict[int, int], totals: np.ndarray) -> dict:
    keys = np.array(sorted(found), np.int64)
    return {"find": keys, "number": np.array([found[k] for k in keys.tolist()], np.int64), "n": totals.astype(float), "kept": np.ones(len(totals), bool)}


def build_tree(coded: DataFrame, head_counts: np.ndarray, other: int, total: int, depth: int, p_symbol: float, p_context: float, z: float) -> Tree:
    """The tree from coded training texts. ``head_counts`` starts with the end's count. The driver holds at most
    ``1 / p_context`` contexts and ``1 / p_symbol`` entries a level."""
    spark = coded.sparkSession
    n_symbol = np.concatenate([[other], head_counts]).astype(float)
    tree = Tree((n_symbol + 0.1) / (n_symbol.sum() + 0.1 * len(n_symbol)))
    tree.trained = total > 0
    train = coded.where(~F.col("held_out")).select("symbols")
    least = max(p_context * total, 1.0)
    # contexts of one symbol: all symbols but "other"; an end is the context of a text's first word
    singles = [s for s in range(END, len(n_symbol)) if n_symbol[s] >= least]
    level, parent, lower = _level({s: i for i, s in enumerate(singles)}, n_symbol[singles]), np.zeros(len(singles), np.int64), None
    tree.first[singles] = np.arange(len(singles))
    for d in range(1, depth + 1):
        if not len(level["n"]):
            break
        tree.levels.append(level)
        sent = spark.sparkContext.broadcast(tree)
        pairs = train.mapInArrow(_count_contexts(sent, d), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        pairs = materialise(pairs.select(F.shiftright("key", 32).alias("c"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("x"), "n"), f"lm-next-{d}")
        contexts = spark.createDataFrame([(i, int(p), float(n)) for i, (p, n) in enumerate(zip(parent.tolist(), level["n"].tolist(), strict=True))], "c long, p long, n_c double")
        # what the suffix expects: the symbols' own counts, or the counts after the context of one symbol less
        if lower is None:
            below = spark.createDataFrame([(0, i, float(n)) for i, n in enumerate(n_symbol.tolist()) if n > 0], "p long, x long, n_x double").withColumn("n_p", F.lit(float(n_symbol.sum())))
        else:
            below = lower[0].select(F.col("c").alias("p"), "x", F.col("n").cast("double").alias("n_x")).join(F.broadcast(lower[1].select(F.col("c").alias("p"), F.col("n_c").alias("n_p"))), "p")
        share = F.col("n_x") / F.col("n_p")
        expected = below.join(F.broadcast(contexts), "p").where(F.col("n_c") * share >= 5).select("c", "x", "n_c", share.alias("share"))
        both = expected.join(pairs, ["c", "x"], "left").withColumn("o", F.coalesce("n", F.lit(0)).cast("double"))
        term = F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (F.col("n_c") * F.col("share")))).otherwise(0.0)
        tested = {r["c"]: r for r in both.groupBy("c").agg(F.count("*").alias("k"), F.sum(term).alias("g"), F.sum("o").alias("o"), F.sum("share").alias("share")).collect()}
        width = {r["c"]: (r["k"], r["n"]) for r in pairs.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
        n_next = np.array([width.get(i, (0, 0))[1] for i in range(len(level["n"]))], float)
        for i, n in enumerate(level["n"].tolist()):
            r = tested.get(i)
            rest, rest_expected = n - (r["o"] if r else 0), n * (1 - (r["share"] if r else 0))
            g = 2 * ((r["g"] if r else 0) + (rest * np.log(rest / rest_expected) if rest > 1e-9 and rest_expected > 1e-9 else 0))
            df = r["k"] if r else 0
            level["kept"][i] = df > 0 and g > df + z * np.sqrt(2 * df)
        stored = pairs.where(F.col("n") >= max(p_symbol * total, 2.0)).select(F.expr("shiftleft(c, 32) | x").alias("key"), "n").toPandas()
        key, count = stored["key"].to_numpy(np.int64), stored["n"].to_numpy(np.int64)
        order = np.argsort(key)
        key, count = key[order], count[order]
        in_store = np.bincount(key >> 32, count, len(level["n"]))
        distinct = np.array([width.get(i, (0, 0))[0] for i in range(len(level["n"]))], float)
        level["total"], level["low"] = np.maximum(n_next + distinct, 1), np.maximum(n_next - in_store + distinct, 1)
        on = level["kept"][key >> 32] if len(key) else np.empty(0, bool)
        level["entries"], level["counts"] = key[on], count[on].astype(float)
        sent.unpersist()
        # contexts of one symbol more: (c, x) is long enough a string if it is frequent, and its suffix is a context of this level
        grown = pairs.where((F.col("n") >= least) & (F.col("x") >= END + 1)).select("c", "x", "n").collect()
        spelled = _spell(tree.levels)
        number = {t: i for i, t in enumerate(spelled)}
        found, totals, parents = {}, [], []
        for r in sorted(grown, key=lambda r: (r["c"], r["x"])):
            string = (*spelled[r["c"]], r["x"])
            if (suffix := number.get(string[1:])) is not None:
                found[(suffix << 32) | string[0]] = len(totals)
                totals.append(r["n"])
                parents.append(suffix)
        lower = (pairs, contexts)
        level, parent = _level(found, np.array(totals, float)), np.array(parents, np.int64)
    return tree


def _spell(levels: list[dict]) -> list[tuple[int, ...]]:
    """The symbols, oldest first, of each context of the last level."""
    spelled: list[tuple[int, ...]] = [()]
    for level in levels:
        out: list[tuple[int, ...]] = [()] * len(level["number"])
        for key, i in zip(level["find"].tolist(), level["number"].tolist(), strict=True):
            out[i] = (key & 0xFFFFFFFF, *spelled[key >> 32])
        spelled = out
    return spelled


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, p_symbol: float = 1e-6, p_context: float = 1e-4, z: float = 4.0, least: int = 20) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The trunk has at most ``1 / p_context`` contexts a length and ``1 / p_symbol`` entries; contexts have up to ``depth`` words. The
    leaves are all head words that occur ``least`` times or more, with all their pairs that occur twice.

    Null and empty texts are one end token. Very long texts are scored whole. Rows that repeat each train and are each scored;
    equal texts get equal scores. With no training documents every word has its smoothed share of an empty count. An empty table
    gives an empty table; other columns are not read.
    """
    spark, since = docs.sparkSession, scratch_mark()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = materialise(picked.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = totals["n"] or 0, totals["v"]
    is_head = (F.col("n") >= p_symbol * total) & (F.col("key") != END_HASH)
    found = counts.where(is_head).orderBy("key").toPandas()
    head, head_n = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    end_n = sum(r["n"] for r in counts.where(F.col("key") == END_HASH).collect())
    other_n, other_v = total - int(head_n.sum()) - end_n, distinct - len(head) - (end_n > 0)

    sent = spark.sparkContext.broadcast(head)
    coded = picked.mapInArrow(_encode(sent), "doc_id long, held_out boolean, n_tokens long, symbols binary, others array<long>")
    coded = materialise(coded.withColumn("rid", F.monotonically_increasing_id()), "lm-coded")
    head_counts = np.concatenate([[end_n], head_n])
    tree = build_tree(coded, head_counts, other_n, total, depth, p_symbol, p_context, z)
    pairs = grow_leaves(tree, coded, np.concatenate([[other_n], head_counts]), total, p_context, least)

    space = total + 0.1 * (distinct + 1)
    base = np.concatenate([[0.0], np.log10((head_counts + 0.1) / space)])
    sent_tree = spark.sparkContext.broadcast(tree)
    # each text's pairs meet the leaves' table; no key has more than a share of p_context of all pairs. The table's keys are unique,
    # so a partition's part of it is an even share, and hashing that spares the sort of the texts' pairs
    gains = coded.select("rid", "symbols").mapInArrow(_leaf_pairs(sent_tree), "rid long, key long, n long").join(pairs.mapInArrow(_delta(sent_tree), "key long, delta double").hint("shuffle_hash"), "key")
    gains = materialise(gains.groupBy("rid").agg(F.sum(F.col("n") * F.col("delta")).alias("leaf_gain")), "lm-gains")
    drop_scratch(spark, since, keep=("lm-words", "lm-coded", "lm-gains"))
    model = coded.select("rid", "doc_id", "held_out", "n_tokens", "symbols").mapInArrow(_score(sent_tree, spark.sparkContext.broadcast(base)), "rid long, doc_id long, held_out boolean, n_tokens long, base double, known long, model double")
    rare = counts.where(~is_head).select("key", F.col("n").alias("c"))
    tail = coded.select("rid", F.explode("others").alias("key")).join(rare, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    other_space = other_n + 0.1 * (other_v + 1)
    tail = tail.groupBy("rid").agg(F.sum((F.col("c") > 0).cast("long")).alias("tail_known"), F.sum(F.log10((F.col("c") + 0.1) / space)).alias("tail_base"), F.sum(F.log10((F.col("c") + 0.1) / other_space)).alias("tail_model"))
    zero = F.lit(0)
    return model.join(tail, "rid", "left").join(gains, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("tail_model", F.lit(0.0)) + F.coalesce("leaf_gain", F.lit(0.0))).alias("score"))
