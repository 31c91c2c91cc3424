"""Language-model scores from Elias-Fano n-gram tries.

The model is a bigram one by absolute discounting over a smoothed unigram level. It is held in shards by context, and
each shard is a trie in one compact buffer: sorted contexts with a quantised back-off weight each, monotone pointers
into the level of successors, and that level with a quantised smoothed probability for each pair. Contexts, pointers
and successors are in Elias-Fano code with samples, and are searched as they are: a query finds its context, the
pointers give its range of the next level, and the successor is searched relative to the value in front of that range.
Only the chunks that are touched are opened. A buffer may be part of a table's row or a file that is mapped to memory.

Documents are worked on in batches. A batch asks each shard once for its distinct pairs and words there, in one message
that also carries the batch's training counts; no message is empty, so they never outnumber the pairs. A shard first
adds up what all batches bring, builds its trie and then answers each of them from it. Contexts that are hot in some
batch are spread over all shards by their successors; their few totals travel apart.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logaudit.llm.common import written

FOLDS, HELD = 5, 1
END = np.uint64(1)
#: Tokens of a batch, which one task holds, and of a shard's share.
BATCH_TOKENS = 1_000_000
SHARD_TOKENS = 1_000_000
#: What is taken off each pair's count, for unseen ones.
DISCOUNT = 0.75
#: A context with this share of a batch is hot there; at most twice as many can reach half of it in all.
HOT = 1000
_SLICE_BYTES = 8_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Elias-Fano

#: Values between two samples. A chunk of low bits takes whole bytes.
CHUNK = 4096


class Level:
    """Non-decreasing unsigned integers in Elias-Fano code: low bits packed, high parts as a unary bitmap, and for each
    chunk its first value and the place of its first bit. Works on any buffer and reads what a query needs of it."""

    def __init__(self, data):
        view = memoryview(data)
        self.n, self.low, chunks, size = (int(x) for x in np.frombuffer(view[:32], dtype="<u8"))
        at = 32 + 8 * chunks
        self.heads = np.frombuffer(view[32:at], dtype="<u8")
        self.bits = np.frombuffer(view[at : at + 8 * chunks], dtype="<u8")
        at += 8 * chunks
        self.lows = np.frombuffer(view[at : at + size], dtype=np.uint8)
        self.highs = np.frombuffer(view[at + size :], dtype=np.uint8)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        lows = []
        for i in range(0, n, CHUNK):  # a chunk at a time: the bits of a value take a byte each here
            part = (v[i : i + CHUNK, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            lows.append(np.packbits(part.astype(np.uint8).reshape(-1)).tobytes())
        packed = b"".join(lows)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, dtype=np.uint8)
        np.bitwise_or.at(bitmap, ones >> 3, (128 >> (ones & 7)).astype(np.uint8))
        head = np.array([n, low, len(lows), len(packed)], dtype="<u8").tobytes()
        return head + v[::CHUNK].astype("<u8").tobytes() + ones[::CHUNK].astype("<u8").tobytes() + packed + bitmap.tobytes()

    def chunk(self, c: int) -> np.ndarray:
        """The values of one chunk."""
        n = min(CHUNK, self.n - c * CHUNK)
        first = int(self.bits[c])
        last = int(self.bits[c + 1]) if c + 1 < len(self.bits) else 8 * len(self.highs)
        found = np.flatnonzero(np.unpackbits(self.highs[first >> 3 : (last + 7) >> 3]))
        found = found[found >= (first & 7)][:n] + (first >> 3 << 3) - c * CHUNK - np.arange(n)
        values = found.astype(np.uint64) << np.uint64(self.low)
        start = c * CHUNK * self.low // 8
        lows = np.unpackbits(self.lows[start : start + (n * self.low + 7) // 8], count=n * self.low).reshape(n, self.low)
        for i in range(self.low):
            values |= lows[:, i].astype(np.uint64) << np.uint64(i)
        return values

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at places in ascending order."""
        out = np.zeros(len(places), dtype=np.uint64)
        of = places // CHUNK
        for c in np.unique(of).tolist():
            i, j = np.searchsorted(of, (c, c + 1))
            out[i:j] = self.chunk(c)[places[i:j] - c * CHUNK]
        return out

    def search(self, values: np.ndarray) -> np.ndarray:
        """The place of the first of each of some ascending values, or -1. Values of a level must differ."""
        out = np.full(len(values), -1, dtype=np.int64)
        of = np.searchsorted(self.heads, values, side="right") - 1
        for c in np.unique(of[of >= 0]).tolist():
            i, j = np.searchsorted(of, (c, c + 1))
            own = self.chunk(c)
            k = np.minimum(np.searchsorted(own, values[i:j]), len(own) - 1)
            out[i:j] = np.where(own[k] == values[i:j], k + c * CHUNK, -1)
        return out


#: The least logarithm of a probability that a code tells; two bytes tell it to within ``STEP / 2``.
FLOOR = -12.0
STEP = -FLOOR / 65534


def quantise(logs: np.ndarray) -> np.ndarray:
    """Two bytes for a logarithm to base 10 of a probability; 0 stands for none."""
    return (np.clip(np.round((logs - FLOOR) / STEP), 0, 65534) + 1).astype("<u2")


def restore(codes: np.ndarray) -> np.ndarray:
    """The probabilities that codes stand for."""
    return np.where(codes > 0, 10 ** (FLOOR + (codes.astype(np.float64) - 1) * STEP), 0.0)


class Trie:
    """One shard's model in a buffer, such as a table's value or a mapped file."""

    def __init__(self, data):
        view = memoryview(data)
        ends = np.cumsum(np.concatenate(([0], np.frombuffer(view[:40], dtype="<u8").astype(np.int64)))) + 40
        part = [view[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        self.contexts, self.pointers, self.successors = (Level(x) for x in part[:3])
        self.backoffs, self.weights = (np.frombuffer(x, dtype="<u2") for x in part[3:])

    @staticmethod
    def encode(contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, backoffs: np.ndarray, weights: np.ndarray) -> bytes:
        """A buffer from ascending contexts, where the successors of each start (and where the last ones end), the
        successors, ascending within a context, and the codes."""
        start, n = pointers[:-1].astype(np.int64), np.diff(pointers.astype(np.int64))
        # Each context's successors go on from the last value of the context before, and one: so the level ascends.
        last = successors[start + n - 1].astype(np.uint64) + np.uint64(1) if len(n) else np.empty(0, np.uint64)
        base = np.cumsum(last) - last
        level = successors.astype(np.uint64) + np.repeat(base, n)
        parts = [Level.encode(contexts), Level.encode(pointers), Level.encode(level), backoffs.astype("<u2").tobytes(), weights.astype("<u2").tobytes()]
        return np.array([len(x) for x in parts], dtype="<u8").tobytes() + b"".join(parts)

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie in a file, mapped to memory."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        """Codes of the back-off weights of ascending contexts, 0 for those that the trie doesn't have."""
        at = self.contexts.search(contexts)
        return np.where(at >= 0, self.backoffs[at] if len(self.backoffs) else 0, 0).astype("<u2")

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of pairs, in ascending order of context and successor; 0 for those that the trie doesn't have."""
        out = np.zeros(len(contexts), dtype="<u2")
        first = np.flatnonzero(np.diff(contexts, prepend=contexts[:1] + np.uint64(1)))
        which = np.cumsum(np.isin(np.arange(len(contexts)), first)) - 1
        node = self.contexts.search(contexts[first])
        known = node >= 0
        low, high = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        low[known] = self.pointers.at(node[known]).astype(np.int64)
        high[known] = self.pointers.at(node[known] + 1).astype(np.int64)
        base = np.zeros(len(node), np.uint64)
        inner = known & (low > 0)
        base[inner] = self.successors.at(low[inner] - 1) + np.uint64(1)
        asked = np.flatnonzero(known[which])
        of = which[asked]
        target = base[of] + successors[asked].astype(np.uint64)
        # Beyond its range a target could pass the next context's values: such a one isn't there.
        end = np.zeros(len(node), np.uint64)
        end[known] = self.successors.at(high[known] - 1)
        inside = target <= end[of]
        asked, of, target = asked[inside], of[inside], target[inside]
        at = self.successors.search(target)
        good = (at >= low[of]) & (at < high[of])
        out[asked[good]] = self.weights[at[good]]
        return out


# Batches


def _hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts: hashes of their tokens with an end after each text, and how many each has."""
    import xxhash

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // _SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b == a:
            continue
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 17) for w in words), dtype=np.uint64, count=len(words))
        empty = np.fromiter((not w for w in words), dtype=bool, count=len(words))
        which = coded.indices.to_numpy(zero_copy_only=False)
        real = ~empty[which] if len(words) else np.empty(0, bool)
        at = np.concatenate(([0], np.cumsum(real)))[lists.offsets.to_numpy(zero_copy_only=False)]
        yield np.insert(hashes[which][real] if len(words) else np.empty(0, np.uint64), at[1:], END), np.diff(at) + 1


def _batched(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            tokens = np.concatenate([h[2] for h in held])
            uniq, index, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which compress well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            planes = rank[index].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            ids = pa.concat_arrays([h[0] for h in held])
            out = pa.concat_arrays([h[1] for h in held]).to_numpy(zero_copy_only=False)
            values = [
                np.concatenate([h[3] for h in held]).astype("<u4").tobytes(), out.astype(np.uint8).tobytes(),
                uniq[order].astype("<u8").tobytes(), pa.compress(planes, codec="zstd", asbytes=True),
            ]
            columns = [pa.array([(part << 32) + seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns += [pa.array([len(tokens)], pa.int64())] + [pa.array([v], pa.binary()) for v in values]
            return pa.RecordBatch.from_arrays(columns, names=names)

        size = 0
        for batch in batches:
            at = 0
            for tokens, counts in _hashed(batch.column(2)):
                held.append((batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), tokens, counts))
                at, size = at + len(counts), size + len(tokens)
                if size >= BATCH_TOKENS:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    return run


class _Batch:
    """A batch row opened: words, tokens by their numbers, and distinct pairs with their shard."""

    def __init__(self, counts: bytes, held: bytes, uniq: bytes, planes: bytes, n: int):
        self.counts = np.frombuffer(counts, dtype="<u4").astype(np.int64)
        self.held = np.frombuffer(held, dtype=np.uint8).astype(bool)
        self.words = np.frombuffer(uniq, dtype="<u8").astype(np.uint64)
        raw = pa.decompress(planes, decompressed_size=4 * n, codec="zstd", asbytes=True)
        self.tokens = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
        self.train = np.repeat(~self.held, self.counts)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context and word numbers of distinct pairs, the pair of each token, and training counts."""
        end = int(np.flatnonzero(self.words == END)[0])
        before = np.concatenate(([end], self.tokens[:-1]))  # a text starts behind an end
        found, which = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        counts = np.bincount(which[self.train], minlength=len(found))
        return found // len(self.words), found % len(self.words), which, counts

    def shards(self, contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
        c, w = self.words[contexts], self.words[words]
        spread = np.isin(self.words, hot)[contexts]
        return ((_mixed(c) + np.where(spread, _mixed(w ^ np.uint64(0x5555)), np.uint64(0))) % np.uint64(n)).astype(np.int64)


def _parted(shard: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each shard's members, in order."""
    return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=n))[:-1])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, _Batch]]:
    for k in range(len(batch)):
        row = {name: batch.column(name)[k] for name in ("batch", "ids", "tokens", "counts", "held", "uniq", "planes")}
        yield row["batch"].as_py(), row["ids"].values, _Batch(*(row[c].as_py() for c in ("counts", "held", "uniq", "planes")), row["tokens"].as_py())


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, b in _opened(batch):
            n = b.word_counts()
            big = np.flatnonzero((n * HOT >= max(1, n.sum())) & (n > 0))
            yield pa.RecordBatch.from_arrays([pa.array(b.words[big].view(np.int64)), pa.array(n[big], pa.int64())], names=["h", "n"])


def _hot_counts(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b in _opened(batch):
                own = np.flatnonzero(np.isin(b.words, hot))
                yield pa.RecordBatch.from_arrays([pa.array(b.words[own].view(np.int64)), pa.array(b.word_counts()[own], pa.int64())], names=["h", "n"])

    return run


_ASKED = "shard int, batch long, ctx binary, runs binary, succ binary, n binary, words binary, wn binary"


def _asking(hot: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, b in _opened(batch):
                contexts, words, _, counts = b.pairs()
                shard, own = b.shards(contexts, words, hot, shards), (_mixed(b.words) % np.uint64(shards)).astype(np.int64)
                wn = b.word_counts()
                for s, (p, w) in enumerate(zip(_parted(shard, shards), _parted(own, shards), strict=True)):
                    if not len(p) and not len(w):
                        continue
                    first = np.flatnonzero(np.diff(contexts[p], prepend=-1))
                    runs = np.diff(np.append(first, len(p)))
                    values = [
                        b.words[contexts[p][first]].astype("<u8"), runs.astype("<u4"), (b.words[words[p]] >> np.uint64(32)).astype("<u4"),
                        counts[p].astype("<u4"), b.words[w].astype("<u8"), wn[w].astype("<u4"),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([name], pa.int64())] + [pa.array([v.tobytes()], pa.binary()) for v in values],
                        names=["shard", "batch", "ctx", "runs", "succ", "n", "words", "wn"],
                    )

    return run


_ANSWERED = "kind string, shard int, batch long, a binary, b binary, c binary"


def built(c: np.ndarray, s: np.ndarray, k: np.ndarray, hot: np.ndarray, hot_n: np.ndarray, discount: float) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A trie from pairs and their counts, in any order and repeated; then the hot contexts in it and how many
    successors each has. Totals of hot contexts are given, since their successors lie in other shards too."""
    by = np.lexsort((s, c))
    c, s, k = c[by], s[by], k[by]
    first = np.flatnonzero((np.diff(c, prepend=c[:1] + np.uint64(1)) != 0) | (np.diff(s.astype(np.int64), prepend=-1) != 0)) if len(c) else np.empty(0, np.int64)
    c, s, k = c[first], s[first], np.add.reduceat(k, first) if len(first) else k
    contexts, starts = np.unique(c, return_index=True)
    pointers = np.append(starts, len(c))
    kinds = np.diff(pointers)
    total = np.add.reduceat(k, starts) if len(starts) else np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(hot, contexts), max(0, len(hot) - 1))
    warm = hot[at] == contexts if len(hot) else np.zeros(len(contexts), bool)
    if warm.any():
        total[warm] = hot_n[at[warm]]
    weights = quantise(np.log10(np.maximum(k - discount, 1e-9) / np.repeat(total, kinds)))
    return Trie.encode(contexts, pointers, s, quantise(np.log10(discount * kinds / total)), weights), contexts[warm], kinds[warm]


def _answering(hot: np.ndarray, hot_n: np.ndarray, discount: float):
    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
        shard = table.column("shard")[0].as_py()
        ctx = np.concatenate([np.repeat(c, r) for c, r in zip(read("ctx", "<u8"), read("runs", "<u4"), strict=True)])
        succ = read("succ", "<u4")
        sizes, succ = [len(x) for x in succ], np.concatenate(succ)
        n, words, wn = np.concatenate(read("n", "<u4")), read("words", "<u8"), read("wn", "<u4")
        seen = n > 0
        data, warm, kinds = built(ctx[seen], succ[seen], n[seen].astype(np.int64), hot, hot_n, discount)
        trie = Trie(data)
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(wn), minlength=len(every)).astype(np.int64)
        backoff = trie.backoff(every)
        order = np.lexsort((succ, ctx))
        codes = np.empty(len(ctx), dtype="<u2")
        codes[order] = trie.find(ctx[order], succ[order])
        ends, w_ends = np.cumsum(sizes), np.cumsum([len(w) for w in words])
        out = [
            ("stat", shard, None, np.array([total.sum(), (total > 0).sum()], dtype="<i8").tobytes(), None, None),
            ("trie", shard, None, data, None, None),
            ("hot", shard, None, warm.astype("<u8").tobytes(), kinds.astype("<u8").tobytes(), None),
        ]
        for name, p, m, w, q in zip(table.column("batch").to_pylist(), ends, sizes, w_ends, words, strict=True):
            own = place[w - len(q) : w]
            out.append(("answer", shard, name, codes[p - m : p].tobytes(), total[own].astype("<u8").tobytes(), backoff[own].tobytes()))
        return pa.Table.from_arrays(
            [pa.array(col, t) for col, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)],
            names=["kind", "shard", "batch", "a", "b", "c"],
        )

    return run


def _scoring(hot: np.ndarray, hot_backoff: np.ndarray, shards: int, total: int, kinds: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers")
            for k, (_, ids, b) in enumerate(_opened(batch)):
                contexts, words, which, _ = b.pairs()
                shard, own = b.shards(contexts, words, hot, shards), (_mixed(b.words) % np.uint64(shards)).astype(np.int64)
                code, c, back = np.zeros(len(contexts), "<u2"), np.zeros(len(b.words), np.int64), np.zeros(len(b.words))
                of_pairs, of_words = _parted(shard, shards), _parted(own, shards)
                for x in answers[k].as_py():
                    code[of_pairs[x["shard"]]] = np.frombuffer(x["a"], dtype="<u2")
                    w = of_words[x["shard"]]
                    c[w] = np.frombuffer(x["b"], dtype="<u8").astype(np.int64)
                    back[w] = restore(np.frombuffer(x["c"], dtype="<u2"))
                at = np.minimum(np.searchsorted(hot, b.words), max(0, len(hot) - 1))
                if len(hot):
                    warm = hot[at] == b.words
                    back[warm] = hot_backoff[at[warm]]
                single = (c + 0.5) / (total + 0.5 * (kinds + 1))
                # A context without training tokens leaves all to the unigram level.
                p = np.where(c[contexts] > 0, restore(code) + back[contexts] * single[words], single[words])
                ends = np.cumsum(b.counts)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
                first = ends - b.counts
                exact = lambda x: np.add.reduceat(x, first)
                p = np.minimum(p, 1.0)  # codes may be rounded up
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(b.held), pa.array(b.counts, pa.int64()), pa.array(sums((c > 0)[b.tokens].astype(np.int64)), pa.int64()),
                        pa.array(np.full(len(ids), total), pa.int64()), pa.array(exact(np.log10(single)[b.tokens])), pa.array(exact(np.log10(p)[which])),
                    ],
                    names=schema.names,
                )

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, discount: float = DISCOUNT
) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows, and the model's tries, learned from the rows that aren't held out.

    Scores: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row. Tries:
    ``shard, trie``, each a buffer for ``Trie``. A token's probability is told to within ``STEP / 2`` of its
    logarithm, so a text's score is to within that times its tokens.

    A row is held out if the CRC-32 of its id's text leaves 1 of 5. Null and empty texts are an end alone; null
    ids count as an empty text of an id; repeated rows count as often as they come; without training rows every
    token has the same probability; an empty table gives no rows; further columns are ignored; a very long text is a
    batch of its own. A pair is known by its context's 64-bit hash and 32 bits of its word's.
    """
    key = docs.schema[id_col].dataType
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(key)), T.StructField("tokens", T.LongType())]
    kind = T.StructType(fields + [T.StructField(c, T.BinaryType()) for c in ("counts", "held", "uniq", "planes")])
    batches = written(rows.mapInArrow(_batched(kind.names), kind), "batches")
    size = batches.agg(F.sum("tokens").alias("n")).first().n or 0
    shards = max(4, -(-size // shard_tokens))
    seen = batches.mapInArrow(_hot, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hot = np.sort(np.array([r.h for r in seen.where(F.col("n") * 2 * HOT >= size).select("h").collect()], dtype=np.int64).view(np.uint64))
    totals = batches.mapInArrow(_hot_counts(hot), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    of_hot = {r.h: r.n for r in totals.collect()}  # at most 2 * HOT
    hot_n = np.array([of_hot[h] for h in hot.view(np.int64).tolist()], dtype=np.int64)
    asked = batches.mapInArrow(_asking(hot, shards), _ASKED)
    answered = written(asked.groupBy("shard").applyInArrow(_answering(hot, hot_n, discount), _ANSWERED), "answered")
    stat = answered.where("kind = 'stat'").mapInArrow(_stats, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    kinds = answered.where("kind = 'hot'").mapInArrow(_hot_kinds, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # at most 2 * HOT
    few = dict((r.h, r.n) for r in kinds)
    hot_backoff = np.array([discount * few.get(h, 0) / n for h, n in zip(hot.view(np.int64).tolist(), hot_n.tolist(), strict=True)])
    out = T.StructType(
        [T.StructField("doc_id", key), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    own = answered.where("kind = 'answer'").groupBy("batch").agg(F.collect_list(F.struct("shard", "a", "b", "c")).alias("answers"))
    joined = batches.join(own, "batch")
    run = _scoring(hot, hot_backoff, shards, stat.n or 0, stat.v or 0, out)
    return joined.mapInArrow(run, out), answered.where("kind = 'trie'").select("shard", F.col("a").alias("trie"))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in batch.column("a").to_pylist():
            n, v = np.frombuffer(a, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], names=["n", "v"])


def _hot_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, dtype="<i8")), pa.array(np.frombuffer(b, dtype="<i8"))], names=["h", "n"])


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
