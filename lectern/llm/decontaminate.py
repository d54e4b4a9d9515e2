"""Benchmark decontamination: latent semantic retrieval of passages, then common-subsequence and answer checks."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NOT_WORD, pieces, words

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
BLOCK = 4
SIZE_STEP = 8
PASSAGE = 64
FEW = 64
TASKS = 4
TASK_BYTES = 32 << 20
STEP = 2.0 ** -24
STRIP = 8192


def features(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray):
    return words(data, offsets, NOT_WORD)


def passages(word: np.ndarray, row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse TF-IDF matrix of passages of up to PASSAGE words, rows of length 1: passage, feature, value."""
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(row)]])))
    new = first | (place % PASSAGE == 0)
    passage = np.cumsum(new) - 1
    key, times = np.unique(passage * FEATURES + features(word), return_counts=True)
    of, feature = np.divmod(key, FEATURES)
    value = times * idf[feature]
    norm = np.sqrt(np.bincount(of, value ** 2))
    return of, feature, value / np.maximum(norm[of], 1e-12)


def summed(key: np.ndarray, at: np.ndarray, value: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of value * rows[at] by key (in order, below n): entry by entry, what a key has beyond FEW as one product."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if not len(key):
        return out
    value = value.astype(np.float32)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(start, len(key)))
    often = np.argsort(-times, kind="stable")
    start, times = start[often], times[often]
    total = np.zeros((len(start), rows.shape[1]), np.float32)
    some = np.empty_like(total)
    for j in range(min(FEW, times[0])):
        entry = start[:np.searchsorted(-times, -j)] + j
        part = np.take(rows, at[entry], axis=0, out=some[:len(entry)], mode="clip")
        part *= value[entry, None]
        total[:len(entry)] += part
    for k in range(np.searchsorted(-times, -FEW)):
        a, b = start[k] + FEW, start[k] + times[k]
        total[k] += value[a:b] @ rows[at[a:b]]
    out[key[start]] = total
    return out


def times_right(of: np.ndarray, feature: np.ndarray, value: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A @ right."""
    return summed(of, feature, value, right, int(of[-1]) + 1 if len(of) else 0)


def transposed(of: np.ndarray, feature: np.ndarray, value: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A.T @ left."""
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    return summed(feature[order], of[order], value[order], left, FEATURES)


@dataclass(frozen=True)
class Space:
    """IDF over all documents, and word vectors: the IDF-weighted directions of the passages' latent space."""
    idf: np.ndarray
    vectors: np.ndarray


def fit_space(docs: DataFrame, rank: int, more: int, seed: int = 5) -> Space:
    """Document frequencies over every row, then a randomised SVD of the TF-IDF passages of every row, summed in Spark.

    The range is A'(A omega) for a random omega; the small matrix (A q)'(A q) gives the directions, each scaled to
    unit variance, so that what a whole language shares does not outweigh the rest.  A task sums its passages (one task a
    core, or for TASK_BYTES of text) and sends multiples of STEP, whose sums are exact in any order; these sums are added
    by feature in one task for TASKS of them.  What comes to the driver has FEATURES rows of rank + more numbers,
    whatever the corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, size = np.zeros(FEATURES, np.int64), 0, 0
        for piece, data, offsets in pieces(batches):
            word, row, _, _ = tokens(data, offsets)
            key = np.sort(row * FEATURES + features(word))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            total += np.bincount(key[new] % FEATURES, minlength=FEATURES)
            rows += len(piece)
            size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([*range(FEATURES), -1, -2], pa.int32()),
                                          pa.array([*total.tolist(), rows, size], pa.int64())], ["f", "n"])

    texts = docs.select("text")
    counted = texts.mapInArrow(count, "f int, n bigint").filter("n > 0").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = counted.column("f").to_numpy(), counted.column("n").to_numpy()
    rows, size = int(n[f == -1].sum()), int(n[f == -2].sum())
    df = np.zeros(FEATURES)
    df[f[f >= 0]] = n[f >= 0]
    idf = np.log((rows + 1) / (df + 1)) + 0.1
    width = rank + more
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    texts = texts.coalesce(tasks)
    schema = "f int, c array<float>"

    def sent(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.abs(total).sum(1) > 0)
        for lo in range(0, len(at), 4096):
            f = at[lo:lo + 4096]
            flat = (np.rint(total[f] / STEP) * STEP).astype(np.float32).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))], ["f", "c"])

    def received(total: np.ndarray, batch: pa.RecordBatch) -> None:
        f = batch.column("f").to_numpy()
        np.add.at(total, f, batch.column("c").flatten().to_numpy().reshape(len(f), width))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, width))
        for batch in batches:
            received(total, batch)
        yield from sent(total)

    def drawn_directions() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((FEATURES, width), np.float32)

    def product(made: np.ndarray | None) -> np.ndarray:
        """A'(A omega), omega drawn anew in each task rather than sent; or (A made)'(A made), in the first rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right, total = drawn_directions() if made is None else made, np.zeros((FEATURES, width))
            for _, data, offsets in pieces(batches):
                word, row, _, _ = tokens(data, offsets)
                if not len(word):
                    continue
                a = passages(word, row, idf)
                b = times_right(*a, right)
                if made is None:
                    total += transposed(*a, b)
                else:
                    total[:width] += b.T @ b
            yield from sent(total)

        out = np.zeros((FEATURES, width))
        sums = texts.mapInArrow(run, schema).repartition(max(TASKS, tasks // TASKS), "f").mapInArrow(added, schema)
        for batch in sums.toArrow().to_batches():
            received(out, batch)
        return out

    q, _ = np.linalg.qr(product(None))
    small = product(q.astype(np.float32))[:width]
    power, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(power)[::-1][:rank]
    scale = np.sqrt(np.maximum(power[first], 1e-9 * max(power.max(), 1e-300)))
    return Space(idf, ((q @ turn[:, first]) / scale * idf[:, None]).astype(np.float32))


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, on the bits of one integer."""
    mask: dict = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Rare:
    """Postings of the items' rarest words: a text that holds an item has `need` of its words within 2 * `length`.

    An item of n words may miss n - ceil(verbatim * n) of them, so of that many and `answer_words` more distinct words
    at least `answer_words` are there; the answer itself is among them.  Nothing that `judge` accepts is left out.
    """
    word: np.ndarray
    start: np.ndarray
    item: np.ndarray
    need: np.ndarray
    length: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, own: list[np.ndarray], idf: np.ndarray, verbatim: float, answer_words: int) -> Rare:
        keys, at, need = [], [], []
        for k, w in enumerate(own):
            distinct = np.unique(w)
            distinct = distinct[np.argsort(-idf[features(distinct)], kind="stable")]
            gone = int((1 - verbatim) * len(w) + 1e-9)
            few = max(1, min(answer_words, len(distinct) - gone))
            chosen = distinct[:gone + few]
            keys.append(chosen)
            at.append(np.full(len(chosen), k))
            need.append(few)
        key, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        word, start = np.unique(key[order], return_index=True)
        has = np.zeros(FEATURES, bool)
        has[features(word)] = True
        return cls(word, np.append(start, len(key)), at[order], np.array(need), np.array([len(w) for w in own]), has)

    def places(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) of every posted word with which `need` of the item's posted words begin, near each other."""
        hit = np.flatnonzero(self.feature[features(word)])
        k = np.minimum(np.searchsorted(self.word, word[hit]), len(self.word) - 1)
        same = self.word[k] == word[hit]
        hit, k = hit[same], k[same]
        times = self.start[k + 1] - self.start[k]
        posting = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.start[k], times)
        item, place = self.item[posting], np.repeat(hit, times)
        order = np.argsort(item * len(word) + place)
        item, place = item[order], place[order]
        end = np.arange(len(item)) + self.need[item] - 1
        ok = end < len(item)
        i, j = np.flatnonzero(ok), end[ok]
        ok = (item[i] == item[j]) & (row[place[i]] == row[place[j]]) & (place[j] - place[i] < 2 * self.length[item[i]])
        return item[i[ok]], place[i[ok]]


def contaminated(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", cosine: float = 0.7, verbatim: float = 0.8, paraphrase: float = 0.6,
                 answer_words: int = 4, rank: int = 48, more: int = 8, round_items: int = 100_000,
                 round_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row and benchmark item it holds: doc_id, item_id, the best cosine, common share, and kind.

    Every window of every text, as long as the item and a few words apart, is placed in the latent space of the
    corpus; windows with a cosine of at least `cosine` are candidates.  A candidate's words (with half an item on either
    side) are compared with the item's: it is verbatim if the longest common subsequence has `verbatim` of the item's
    words, a paraphrase if it has `paraphrase` of them and the answer, the item's `answer_words` rarest words, is there.
    Places where enough of an item's rarest words stand near each other are candidates as well, whatever their cosine, so
    every stretch of two item lengths that passes these checks is found.

    The items go to the tasks, in rounds of about `round_items` items and `round_bytes` of text: more items are more
    passes over the documents, and any number is searched.  Null texts and ids: a null text
    holds nothing, rows with a null id are judged like others; wordless items match nothing; repeated rows give
    a row each; an empty table of either kind gives no rows; other columns are not read.
    """
    docs = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, common double, kind string"
    listed = items.select(items[item_id].alias("i"), items[item_text].alias("t")).dropna()
    n, size = listed.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    space = fit_space(docs, rank, more)
    rounds = max(-(-n // round_items), -(-size // round_bytes))
    found = None
    for k in range(rounds):
        part = listed.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k).toArrow()
        some = hold_items(docs, part, space, schema, cosine, verbatim, paraphrase, answer_words)
        found = some if found is None else found.union(some)
    return found


def hold_items(docs: DataFrame, listed: pa.Table, space: Space, schema: str, cosine: float, verbatim: float,
               paraphrase: float, answer_words: int) -> DataFrame:
    """The rows of `contaminated` for some items (i, t), in one pass over the documents."""
    names = listed.column("i").to_pylist()
    parts = pieces(iter([pa.RecordBatch.from_arrays([listed.column("t").combine_chunks()], ["text"])]), limit=1 << 62)
    _, data, offsets = next(parts, (None, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    word, row, _, _ = tokens(data, offsets)
    own = [word[a:b] for a, b in zip(np.searchsorted(row, np.arange(len(names))),
                                     np.searchsorted(row, np.arange(len(names)), "right"))]
    if not any(map(len, own)):
        return docs.sparkSession.createDataFrame([], schema)
    sizes: dict[int, list[int]] = {}
    for k, w in enumerate(own):
        if len(w):
            sizes.setdefault(max(BLOCK, round(len(w) / SIZE_STEP) * SIZE_STEP), []).append(k)
    listed_words = [w.tolist() for w in own]
    answers = [set(np.unique(w)[np.argsort(-space.idf[features(np.unique(w))], kind="stable")[:answer_words]].tolist())
               for w in own]

    rare = Rare.of(own, space.idf, verbatim, answer_words)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    targets = {s: unit(np.stack([space.vectors[features(own[k])].sum(0) for k in at])).T.copy() for s, at in sizes.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.concatenate([space.vectors, np.zeros((1, space.vectors.shape[1]), np.float32)])
        for piece, data, offsets in pieces(batches):
            word, row, _, _ = tokens(data, offsets)
            if not len(word):
                continue
            n = len(piece)
            count = np.bincount(row, minlength=n)
            begin = np.cumsum(count) - count
            # blocks of BLOCK words inside each row; the last one may be short
            blocks = -(-count // BLOCK)
            block_row = np.repeat(np.arange(n), blocks)
            first_block = np.cumsum(blocks) - blocks
            inner = np.arange(len(block_row)) - first_block[block_row]
            block_start = begin[block_row] + inner * BLOCK
            in_block = np.minimum(BLOCK, begin[block_row] + count[block_row] - block_start)
            feature = np.append(features(word), np.full(BLOCK, FEATURES))            # FEATURES: the zero vector
            sums = np.empty((vectors.shape[1], len(block_start)))                  # a row for each dimension: sums run along it
            for lo in range(0, len(block_start), STRIP):
                start, held = block_start[lo:lo + STRIP], in_block[lo:lo + STRIP]
                strip = vectors.take(feature[start], axis=0)
                for k in range(1, BLOCK):
                    strip += vectors.take(np.where(k < held, feature[start + k], FEATURES), axis=0)
                sums[:, lo:lo + STRIP] = strip.T
            np.cumsum(sums, axis=1, out=sums)
            summed = np.zeros((len(block_start) + 1, len(sums)), np.float32)
            for lo in range(0, len(block_start), STRIP):
                summed[lo + 1:lo + STRIP + 1] = sums[:, lo:lo + STRIP].T
            last_block = (first_block + blocks)[block_row]
            left, head = last_block - np.arange(len(block_row)), inner == 0
            best: dict[tuple[int, int], tuple[float, float, str]] = {}
            for size, at in sizes.items():
                width, step = size // BLOCK, max(1, size // (4 * BLOCK * BLOCK))
                # starts `step` blocks apart, up to the last one that reaches the end of the text; a short text has one
                from_ = np.flatnonzero((left > width - step) & (inner % step == 0) | head)
                to = np.minimum(from_ + width, last_block[from_])
                for lo in range(0, len(from_), STRIP):
                    z = summed.take(to[lo:lo + STRIP], axis=0)
                    z -= summed.take(from_[lo:lo + STRIP], axis=0)
                    z /= np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)[:, None]
                    near = z @ targets[size]
                    hit, which = np.divmod(np.flatnonzero((near >= cosine).ravel()), near.shape[1])
                    for i, j in zip(hit.tolist(), which.tolist()):
                        k, b = at[j], from_[lo + i]
                        r = block_row[b]
                        a = max(begin[r], block_start[b] - size // 2)
                        z_ = min(begin[r] + count[r], block_start[b] + size + size // 2)
                        judge(best, (int(r), k), word[a:z_], float(near[i, j]))
            seen: dict[tuple[int, int, int], list[int]] = {}
            for k, f in zip(*(x.tolist() for x in rare.places(word, row))):
                seen.setdefault((int(row[f]), k, f // (2 * len(own[k]))), []).append(f)
            near_places = []
            for (r, k, _), at in seen.items():                # places side by side are first judged by all words around
                low, high = int(begin[r]), int(begin[r] + count[r])
                there = set(word[max(low, at[0] - 2 * len(own[k]) + 1):min(high, at[-1] + 2 * len(own[k]))].tolist())
                if sum(map(there.__contains__, listed_words[k])) >= paraphrase * len(own[k]):
                    near_places += [(k, f) for f in at]
            for k, f in near_places:
                r, n_ = int(row[f]), len(own[k])
                low, high = int(begin[r]), int(begin[r] + count[r])
                around = word[max(low, f - 2 * n_ + 1):min(high, f + 2 * n_)].tolist()
                held = best.get((r, k), (0.0, 0.0))[1]
                most = reach(k, around)
                if most < paraphrase or most <= held or most < verbatim and not answers[k] <= set(around):
                    continue
                # the stretch with its middle at the word first, then all that hold the word
                for a in [f - n_ + 1, *range(f - 2 * n_ + 1, f + 1)]:
                    judge(best, (r, k), word[max(low, a):min(high, a + 2 * n_)], -2.0)
                    if best.get((r, k), (0.0, 0.0))[1] >= most:
                        break
                if best.get((r, k), (0.0, 0.0))[0] == -2.0:
                    b = min(max(low, f - n_ // 2), max(low, high - n_))
                    near_ = unit(space.vectors[features(word[b:b + n_])].sum(0)[None])[0] @ unit(
                        space.vectors[features(own[k])].sum(0)[None])[0]
                    best[r, k] = (float(near_), *best[r, k][1:])
            if best:
                keys = sorted(best)
                found = [best[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array([r for r, _ in keys])),
                     pa.array([names[k] for _, k in keys], listed.schema.field("i").type),
                     pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([f[2] for f in found])],
                    ["doc_id", "item_id", "cosine", "common", "kind"])

    def reach(k: int, text: list) -> float:
        """The common share of an item, 0 if its words alone do not reach `paraphrase`."""
        item, there = listed_words[k], set(text)
        if sum(map(there.__contains__, item)) < paraphrase * len(item):
            return 0.0
        return longest_common(item, text) / len(item)

    def judge(best: dict, key: tuple[int, int], words_: np.ndarray, near: float) -> None:
        k = key[1]
        text = words_.tolist()
        share = reach(k, text)
        if share < paraphrase or share < verbatim and not answers[k] <= set(text):
            return
        kind = "verbatim" if share >= verbatim else "paraphrase"
        if key not in best or (share, near) > (best[key][1], best[key][0]):
            best[key] = (near, share, kind)

    return docs.mapInArrow(search, schema)
