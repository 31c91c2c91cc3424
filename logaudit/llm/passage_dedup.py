"""Repeated passages by paragraph MinHash banding.

A text has two kinds of paragraphs: its lines of ten words or more, and its sliding paragraphs, the 25 words that
begin at each place. Both are banded by MinHash, and both are verified where they collide.

Lines are banded over five-word shingles, with bands tuned for a recall of 0.99 at the similarity; pairs are verified
by exact Jaccard similarity. Sliding paragraphs find passages that begin or end within lines. They have one band, the
least hash of their 16 ten-word shingles: neighbours mostly share it, so it is stored once for a run of them, and any
25 words in common give a common band key. Two passages of over 50 words and a similarity of 0.8 have such a run, for
an edit takes five shingles and they can't have two. Colliding places are aligned word by word, over edits and to both
ends, and an aligned passage is verified by its Jaccard similarity again.

Lines make components; a sliding paragraph's class is its band key. Of each the earliest place stays. Adjacent and
overlapping members are one passage; passages of fewer than 50 words are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logaudit.llm.common import components, shuffle_width, small, written
from logaudit.llm.line_dedup import with_rid
from logaudit.llm.sharding import numbered
from logaudit.llm.simhash import _forest

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
MIN_LINE = 10
#: Rows of a band, and of the bands in which the lines of groups over the bound are dealt anew.
ROWS, MORE_ROWS = 3, (6, 10)
#: Lines of a group that are all compared with each other in one task.
GROUP = 2048
#: Shingles that are compared at a time, for all lines of a group.
COLUMNS = 4096
#: Words of a sliding paragraph and of its shingles.
WINDOW, LONG_SHINGLE = 25, 10
#: Words of a passage, at least.
MIN_PASSAGE = 50
#: Words between two places in common over which an alignment goes on, and by which the two texts may shift there.
GAP, SHIFT = 64, 8
#: Words around a place in common that an alignment may need: no run of 25 words goes without a place of its own.
MARGIN = 40
#: Words of a block in which texts are handed to the texts that they are compared with.
BLOCK = 64
#: Mismatched words in a row that an aligned passage may have.
EDITS = 5
#: Words on each side of a place in which a least passage around it lies, those of a side that deal large groups anew,
#: and places of a group that are asked in one task.
REACH, SIDE, ASKED = MIN_PASSAGE - LONG_SHINGLE + 2, 8, 512
_SLICE_BYTES = 1_500_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 64, least: int = 1) -> tuple[int, int]:
    """Bands and rows: of the pairs whose recall at the similarity is met, the one of fewest hashes that has
    ``least`` rows in a band or more."""
    fits = [
        (b * r, -r, b, r) for b in range(1, most + 1) for r in range(least, most // b + 1) if 1 - (1 - similarity**r) ** b >= recall
    ]
    return min(fits)[2:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded number of bytes, or of one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // _SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


#: Bytes that part words, and bytes with A-Z lowered.
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
#: The primes of XXH64, and the bytes of a text from which on it goes another way.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_WIDE = 32


def _hashed(data: np.ndarray, start: np.ndarray, n: np.ndarray, seed: int = 11) -> np.ndarray:
    """XXH64 of each word's bytes: of all words of under 32 bytes at a time, of longer ones one by one."""
    import xxhash

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    def taken(at: np.ndarray, lanes: np.ndarray, times: np.uint64, bits: int, more: tuple[np.uint64, np.uint64]) -> None:
        out[at] = turned(out[at] ^ (lanes * times), bits) * more[0] + more[1]

    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight, four = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    out = n.astype(np.uint64) + np.uint64(seed) + _P5
    short = n < _WIDE
    for k in range(0, _WIDE - 8, 8):
        at = np.flatnonzero(short & (n >= k + 8))
        taken(at, turned(eight[start[at] + k] * _P2, 31), _P1, 27, (_P1, _P4))
    at = np.flatnonzero(short & (n % 8 >= 4))
    taken(at, four[start[at] + n[at] // 8 * 8].astype(np.uint64), _P1, 23, (_P2, _P3))
    for k in range(3):
        at = np.flatnonzero(short & (n % 4 > k))
        taken(at, data[start[at] + n[at] // 4 * 4 + k].astype(np.uint64), _P5, 11, (_P1, np.uint64(0)))
    for shift, times in ((33, _P2), (29, _P3)):
        out = (out ^ (out >> np.uint64(shift))) * times
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + n[i]].tobytes(), seed)
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words (A-Z lowered, between ASCII white space), how many words each line has, and how
    many lines each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    blank = _BLANK[raw]
    # A word ends at white space and at its text's end.
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = blank[:-1]
    edge[cuts] = True
    start = np.flatnonzero(~blank & edge[:-1])
    edge[:-1] |= blank
    n = np.flatnonzero(~blank & edge[1:]) + 1 - start
    lines = np.flatnonzero(raw == 10)
    per_text = np.diff(np.searchsorted(lines, cuts)) + 1
    line = np.searchsorted(cuts, start, side="right") - 1 + np.searchsorted(lines, start)
    return _hashed(_LOWER[raw], start, n), np.bincount(line, minlength=int(per_text.sum())), per_text


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the words from each place on, so many of them; none at the last places."""
    out = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for i in range(size):
        out = _mixed(out + words[i : len(words) - size + 1 + i])
    return out


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of so many words; of all words if they are fewer."""
    return _rolled(words, min(size, len(words)))


def _extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """The least (greatest) of each so many neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def least_places(words: np.ndarray, lengths: np.ndarray, window: int = WINDOW, size: int = LONG_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the sliding paragraphs of texts of such lengths, laid end to end: the places of their least
    shingles, and these shingles' hashes."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(words) < window:
        return none
    found = _mixed(_rolled(words, size))
    wide = window - size + 1
    text = np.repeat(np.arange(len(lengths)), lengths)
    least = _extreme(found, wide, np.minimum)
    whole = text[: len(least)] == text[window - 1 : window - 1 + len(least)]
    # A shingle is its paragraph's least where some whole paragraph around it has it as the least.
    edge = np.zeros(wide - 1, np.uint64)
    reached = _extreme(np.concatenate((edge, np.where(whole, least, np.uint64(0)), edge)), wide, np.maximum)
    chosen = (reached == found) & (found != 0)
    # One word over and over gives equal hashes side by side: one in each paragraph's width is enough.
    place = np.arange(len(found))
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (text[1 : len(found)] != text[: len(found) - 1])))
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    at = np.flatnonzero(chosen & (since % wide == 0))
    return (at, found[at]) if len(at) else none


def _band_keys(own: np.ndarray, cuts: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A key for each line and band, of lines whose shingles start at the cuts."""
    seeds = _mixed(np.arange(1, n_bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rows << 32))
    keys = np.zeros((len(cuts), n_bands), dtype=np.uint64)
    own = own * np.uint64(0x9E3779B97F4A7C15)
    for i, s in enumerate(seeds):
        x = (own ^ s) * (s | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        # Rows aren't interchangeable within a band: each is mixed with its seed before they are added up.
        keys[:, i // rows] += _mixed(np.minimum.reduceat(x, cuts) + s)
    return _mixed(keys + _mixed(np.arange(n_bands, dtype=np.uint64) + np.uint64(99)))


#: A text's number and a word's place in it, as one long: no string has 2 to the 28 words.
PLACE_BITS = 28


def _place():
    return F.shiftleft("ord", PLACE_BITS) + F.col("start")


def _unplaced(place: str, text: str = "ord", start: str = "start"):
    return F.shiftright(place, PLACE_BITS).alias(text), F.col(place).bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias(start)


_UNITS = "ord long, kind int, start int, n int, h long, keys array<long>"
#: Kinds of units; those of the last have the words back to the place before as their ``n``.
TEXT, LINE, SLIDING, AGAIN = 0, 1, 2, 3


def _units(n_bands: int, rows: int):
    """Texts to a row for each text, line and distinct band key of sliding paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _sliced(batch.column(1)):
                words, per_line, per_text = _words(batch.column(1).slice(a, b - a))
                own = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                text_of_line = np.repeat(np.arange(b - a), per_text)
                lengths = np.bincount(text_of_line, weights=per_line, minlength=b - a).astype(np.int64)
                base = np.cumsum(lengths) - lengths
                text_of_word = np.repeat(np.arange(b - a), lengths)
                at, h = least_places(words, lengths)
                long = np.flatnonzero(per_line >= MIN_LINE)
                first, n = (np.cumsum(per_line) - per_line)[long], per_line[long]
                keys, content, fresh = np.empty((0, n_bands), np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
                if len(long):
                    per = n - (SHINGLE - 1)
                    within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
                    cuts = np.cumsum(per) - per
                    some = _rolled(words, SHINGLE)[np.repeat(first, per) + within]
                    place = within.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                    content = _mixed(np.add.reduceat(_mixed(some + place), cuts) + np.uint64(1))
                    # Equal lines have equal keys: the first one of a slice carries them.
                    fresh = np.zeros(len(long), bool)
                    fresh[np.unique(content, return_index=True)[1]] = True
                    keep = np.repeat(fresh, per)
                    keys = _band_keys(some[keep], np.cumsum(per[fresh]) - per[fresh], n_bands, rows)
                # In a text only the first place of a band key stands for it, others refer to the one before.
                order = np.lexsort((at, h, text_of_word[at]))
                same = np.zeros(len(at), bool)
                same[1:] = (h[order][1:] == h[order][:-1]) & (text_of_word[at[order]][1:] == text_of_word[at[order]][:-1])
                back = np.zeros(len(at), np.int64)
                back[order[same]] = (at[order] - np.concatenate((at[:0], at[order][-1:], at[order][:-1])))[same]
                text = np.concatenate((np.arange(b - a), text_of_line[long], text_of_word[at]))
                start = np.concatenate((np.zeros(b - a, np.int64), first - base[text_of_line[long]], at - base[text_of_word[at]]))
                size = np.concatenate((lengths, n, np.where(back > 0, back, LONG_SHINGLE)))
                counts = (b - a, len(long), len(at))
                offsets = np.concatenate(([0], np.cumsum(np.concatenate((np.zeros(b - a, np.int64), n_bands * fresh, np.zeros(len(at), np.int64))))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[text], pa.int64()), pa.array(np.concatenate((np.repeat((TEXT, LINE), counts[:2]), np.where(back > 0, AGAIN, SLIDING))).astype(np.int32)),
                        pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(b - a, np.uint64), content, h)).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["ord", "kind", "start", "n", "h", "keys"],
                )

    return run


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, int]]:
    """Word hashes of each text of the first column, with its row."""
    for batch in batches:
        for a, b in _sliced(batch.column(0)):
            words, per_line, per_text = _words(batch.column(0).slice(a, b - a))
            text_of_line = np.repeat(np.arange(b - a), per_text)
            ends = np.cumsum(np.bincount(text_of_line, weights=per_line, minlength=b - a).astype(np.int64))
            for i, end in enumerate(ends.tolist()):
                yield words[(int(ends[i - 1]) if i else 0) : end], batch, a + i


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted pieces of texts: 32 bits of each word's hash."""
    for batch in batches:
        for a, b in _sliced(batch.column(0)):
            words, per_line, per_text = _words(batch.column(0).slice(a, b - a))
            short = (words >> np.uint64(32)).astype("<u4")
            lengths = np.bincount(np.repeat(np.arange(b - a), per_text), weights=per_line, minlength=b - a).astype(np.int64)
            wanted = batch.column(2).slice(a, b - a)
            each = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
            start, n = (wanted.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            base, end = np.repeat(np.cumsum(lengths) - lengths, each), np.repeat(np.cumsum(lengths), each)
            low = np.minimum(base + start, end)
            high = np.minimum(low + n, end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), each), pa.int64()),
                    pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array([short[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
                ],
                names=["ord", "start", "n", "words"],
            )


def pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``ord, start, n, words``: the wanted pieces (``ord, start, n``) of texts, which are read once for all of them."""
    of_text = written(wanted.distinct().groupBy("ord").agg(F.collect_list(F.struct("start", "n")).alias("wanted")), "wanted")
    named = of_text.select("ord")
    return rows.join(small(named, named.count()), "ord", "left_semi").join(of_text, "ord").select("text", "ord", "wanted").mapInArrow(_pieces, "ord long, start int, n int, words binary")


# Lines


_SETS = "h long, places long, set array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of lines."""
    for batch in batches:
        sets = [np.unique(shingles(np.frombuffer(w, dtype="<u4").astype(np.uint64))).view(np.int64) for w in batch.column(2).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        flat = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["h", "places", "set"])


def _dealt(n_bands: int, rows: int):
    """Lines in further bands, from their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                sets = batch.column(1).slice(k, 200)
                own = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = _band_keys(own, np.cumsum(n) - n, n_bands, rows).view(np.int64)
                h = batch.column(0).slice(k, 200).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, n_bands)), pa.array(keys.reshape(-1))], names=["h", "key"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[which]
    of, which = of[keep], rank[which[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(which, kind="stable")
    of, which = of[order], which[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(which, (low, low + COLUMNS))
        table = np.zeros((n, COLUMNS), dtype=np.float32)
        table[of[i:j], which[i:j] - low] = 1
        out += table @ table.T
    return out


def _by_group(of):
    """Batches sorted by their first column to ``of`` whole groups of it, as tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last group may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            held.append(pa.Table.from_batches([batch]))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut or held[0].column(0)[0].as_py() != key[0]:
                whole = pa.concat_tables([*held[:-1], held[-1].slice(0, cut)])
                yield from of(whole)
                held = [held[-1].slice(cut)]
        if held:
            yield from of(pa.concat_tables(held))

    return run


def _compared(similarity: float):
    """Sorted groups of lines with their sets to links, as few as connect what is similar enough."""

    def links(h: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in sets], dtype=np.float32)
        common = _common(sets)
        a, b = np.nonzero(np.triu(common >= np.float32(similarity) * (n[:, None] + n[None, :] - common) - np.float32(1e-3), 1))
        label = _forest(len(h), a, b)
        child = np.flatnonzero(label != np.arange(len(h)))
        return h[child], h[label[child]]

    def done(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        key, h = (batch.column(i).to_numpy() for i in (0, 1))
        sets = batch.column(2).combine_chunks()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))))
        flat = sets.flatten().to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(key, prepend=key[:1] - 1)).tolist(), len(key)] if len(key) else []
        found = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                found.append(links(h[i:j], [flat[ends[k] : ends[k + 1]] for k in range(i, j)]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_group(done)


def compared(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect the lines of each group (``key, h``) which are similar enough."""
    dealt = groups.join(sets.select("h", "set"), "h").select("key", "h", "set").repartition(shuffle_width(sets.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compared(similarity), "a long, b long").distinct()


def _met(keyed: DataFrame) -> DataFrame:
    """``key, h``: lines that share a band key with another."""
    ends = written(keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key"), "band_ends")
    return written(keyed.join(ends, "key").distinct(), "met")


def _centred(many: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: each line of a group with the one of most places, from which others are likely to be edited, if they
    are similar enough."""
    middle = many.join(sets.select("h", "places"), "h").groupBy("key").agg(F.max(F.struct("places", "h")).alias("m")).select("key", F.col("m.h").alias("b"))
    pairs = many.join(middle, "key").select(F.col("h").alias("a"), "b").where("a <> b").distinct()
    of = lambda c: sets.select(F.col("h").alias(c), F.col("set").alias(f"s{c}"), F.size("set").alias(f"n{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(common >= F.lit(similarity) * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _apart(many: DataFrame, links: DataFrame) -> DataFrame:
    """``key, h, class``: lines of the groups that the links so far leave in more than one piece."""
    joined = components(links).withColumnRenamed("node", "h")
    now = written(many.join(joined, "h", "left").select("key", "h", F.coalesce("component", "h").alias("class")), "groups")
    open_ = now.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    return written(now.join(open_, "key"), "open_groups")


def colliding_lines(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that share a band key with another (``key, h``), and a place ``h, ord, start, n`` and the
    number of ``places`` of each."""
    lines = units.where(F.col("kind") == LINE)
    met = _met(lines.select("h", F.explode("keys").alias("key")))
    some = lines.join(met.select("h").distinct(), "h").groupBy("h").agg(F.min(F.struct("ord", "start", "n")).alias("x"), F.count("*").alias("places"))
    return met, written(some.select("h", "x.*", "places"), "colliding_lines")


def line_links(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, bound: int = GROUP) -> DataFrame:
    """``a, b``: links that connect the lines which collide in a band and are similar enough.

    In a group of up to ``bound`` lines all are compared with each other in one task. In a larger one each line
    meets the one of most places first; if that leaves the group in pieces, all its lines are dealt anew in bands of
    more rows and other seeds. Groups that are still too large then are compared block by block.
    """
    links = None
    for least in (*MORE_ROWS, None):
        large = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound)
        found = written(compared(met.join(large, "key", "left_anti"), sets, similarity), "links")
        links = found if links is None else links.union(found)
        many = written(met.join(large, "key"), "many")
        if many.isEmpty():
            return links
        links = links.union(written(_centred(many, sets, similarity), "links"))
        left = _apart(many.select("key", "h"), links)
        if left.isEmpty():
            return links
        if least is not None:
            own = sets.join(left.select("h").distinct(), "h").select("h", "set")
            met = _met(own.mapInArrow(_dealt(*bands(similarity, most=1024, least=least)), "h long, key long"))
    # Every two blocks of half the bound, and so every two lines, meet in a group of its own.
    half = max(1, bound // 2)
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks"))
    own = left.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    both = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = both.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "h")
    return links.union(written(compared(named, sets, similarity), "links"))


def line_spans(units: DataFrame, links: DataFrame) -> DataFrame:
    """``ord, start, n, later``: lines that have another place in their class; later unless it is the earliest."""
    linked = written(components(links).withColumnRenamed("node", "h"), "line_classes")
    lines = units.where(F.col("kind") == LINE).select("h", _place().alias("place"), "n")
    several = lines.groupBy("h").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high")
    alone = several.select("h").join(linked.select("h"), "h", "left_anti").select("h", F.col("h").alias("class"))
    of_class = linked.select("h", F.col("component").alias("class")).union(alone)
    found = written(lines.join(of_class, "h").select("place", "n", "class"), "occurrences")
    first = found.groupBy("class").agg(F.min("place").alias("first"))
    return found.join(first, "class").select(*_unplaced("place"), "n", (F.col("place") != F.col("first")).alias("later"))


# Passages


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in common of a text with others to chains: each as far as the next one lies within the gap in both.

    A chain whose places all lie within longer ones of three places or more is left out: around a copy's edits some
    keys are shared with other copies alone, but the passage is aligned with one of them already.
    """
    for batch in (batch.slice(k, 500) for batch in batches for k in range(0, len(batch), 500)):
        out: list[tuple] = []
        flat, each = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        rows = np.stack([np.repeat(np.arange(len(batch)), each), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b_at", "a_at"))])
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, np.concatenate((np.ones(min(1, rows.shape[1]), bool), (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
        cuts = np.searchsorted(rows[0], np.arange(len(batch) + 1)).tolist()
        ordered = list(zip(*rows[1:].tolist(), strict=True))
        for b, low, high in zip(batch.column(0).to_pylist(), cuts, cuts[1:], strict=False):
            found: list[tuple[int, list[tuple[int, int]]]] = []
            recent: list[list[tuple[int, int]]] = []
            of = None
            for a, *p in ordered[low:high]:
                if a != of:
                    of, recent = a, []
                for chain in reversed(recent[-8:]):
                    db, da = p[0] - chain[-1][0], p[1] - chain[-1][1]
                    if 0 < db <= GAP and 0 < da <= GAP and abs(db - da) <= SHIFT:
                        chain.append(tuple(p))
                        break
                else:
                    recent.append([tuple(p)])
                    found.append((a, recent[-1]))
            inside: set[int] = set()
            for i, (a, c) in enumerate(sorted(found, key=lambda x: (-len(x[1]), x[0]))):
                if all(x in inside for x, _ in c):
                    continue
                if len(c) > 2:
                    inside.update(range(c[0][0], c[-1][0] + 1))
                out.append((a, b, i, [x for _, x in c], [x for x, _ in c]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names=["a", "b", "chain", "a_at", "b_at"]
        )


def _shingle_set(words: np.ndarray) -> set[bytes]:
    """The distinct shingles of a passage, as the bytes of their words; all words if they are fewer."""
    text, size = words.tobytes(), words.itemsize
    wide = size * min(SHINGLE, len(words))
    return {text[k : k + wide] for k in range(0, len(text) - wide + 1, size)}


def aligned(x: np.ndarray, y: np.ndarray, places: list[tuple[int, int]], similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Passages that two texts share around places in common: start and length in the first and in the second.

    From each place equal words are followed both ways; runs that then lie within a few words of each other are
    one passage if its similarity, of sets of shingles, is high enough; a run alone has only equal words.
    """
    runs: list[list[int]] = []  # start in x, start in y, length
    for i, j in sorted(places):
        if runs and runs[-1][0] - runs[-1][1] == i - j and i < runs[-1][0] + runs[-1][2]:
            continue
        n = min(len(x) - i, len(y) - j)
        other = np.flatnonzero(x[i : i + n] != y[j : j + n])
        after = int(other[0]) if len(other) else n
        if not after:
            continue
        n = min(i, j)
        other = np.flatnonzero(x[i - n : i] != y[j - n : j])
        before = n - 1 - int(other[-1]) if len(other) else n
        runs.append([i - before, j - before, before + after])
    joined: list[list[list[int]]] = []
    for run in runs:
        last = joined[-1][-1] if joined else None
        near = last and all(-SHIFT <= run[k] - last[k] - last[2] <= EDITS for k in (0, 1)) and run[0] > last[0] and run[1] > last[1]
        if near:
            joined[-1].append(run)
        else:
            joined.append([run])
    out = []
    for parts in joined:
        (i, j, _), (ie, je, n) = parts[0], parts[-1]
        both = [_shingle_set(t[s:e]) for t, s, e in ((x, i, ie + n), (y, j, je + n))] if len(parts) > 1 else [{0}, {0}]
        common = len(both[0] & both[1])
        if common >= similarity * (len(both[0]) + len(both[1]) - common):
            out.append((i, ie + n - i, j, je + n - j))
        else:
            out += [(i, n, j, n) for i, j, n in parts]
    return out


_CHAIN = "a long, b long, chain int, a_at array<int>, b_at array<int>"


def shared_keys(units: DataFrame) -> DataFrame:
    """``h, first, last, n``: band keys of several places, their first and last text's first place, and how many
    places they have."""
    some = units.where(F.col("kind").isin(SLIDING, AGAIN)).select("h", F.when(F.col("kind") == SLIDING, _place()).alias("place"))
    groups = some.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    return written(groups.where("n > 1"), "band_ends")


def chains(units: DataFrame, shared: DataFrame) -> DataFrame:
    """Chains of places in common of pairs of texts, by the band keys that are shared.

    Each text's first place meets the earliest and the last one with its band key, and a further place in the text
    meets the one before, so links are at most twice as many as places.
    """
    sliding = units.where(F.col("kind") == SLIDING).select("h", _place().alias("place"))
    met = sliding.join(shared.where("first <> last").drop("n"), "h").select("place", F.explode(F.array("first", "last")).alias("end")).where("place <> end")
    met = met.select(*_unplaced("end", "a", "a_at"), *_unplaced("place", "b", "b_at")).where("a <> b")
    own = units.where(F.col("kind") == AGAIN).select(F.col("ord").alias("a"), (F.col("start") - F.col("n")).alias("a_at"), F.col("ord").alias("b"), F.col("start").alias("b_at"))
    met = met.union(own)
    of_text = met.groupBy("b").agg(F.collect_list(F.struct("a", "b_at", "a_at")).alias("places"))
    found = of_text.mapInArrow(_chained, _CHAIN)
    # The piece of the second text, and the blocks of the first one.
    low = F.greatest(F.lit(0), F.array_min("b_at") - MARGIN - BLOCK)
    size = F.array_max("b_at") + MARGIN + 2 * BLOCK - low
    first, last = F.greatest(F.lit(0), F.array_min("a_at") - MARGIN), F.array_max("a_at") + MARGIN + LONG_SHINGLE
    blocks = F.sequence((F.floor(first / BLOCK) * BLOCK).cast("int"), last.cast("int"), F.lit(BLOCK))
    return written(found.select("*", low.alias("low"), size.alias("size"), blocks.alias("blocks")), "chains")


def _verified(least: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(k, 500) for batch in batches for k in range(0, len(batch), 500)):
            found: list[tuple] = []
            ends = [np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(i)).to_numpy(zero_copy_only=False)))).tolist() for i in (2, 6)]
            places = list(zip(*(batch.column(i).flatten().to_pylist() for i in (2, 3)), strict=True))
            parts = batch.column(6).flatten()
            blocks = list(zip(*(parts.field(c).to_pylist() for c in ("start", "words")), strict=True))
            for i, (a, b, low, words) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True)):
                own = sorted(blocks[ends[1][i] : ends[1][i + 1]])
                base = own[0][0]
                x = np.frombuffer(b"".join(w for _, w in own), dtype="<u4")
                y = np.frombuffer(words, dtype="<u4")
                for ai, an, bi, bn in aligned(x, y, [(p - base, q - low) for p, q in places[ends[0][i] : ends[0][i + 1]]], similarity):
                    if max(an, bn) >= least:
                        found += [(a, ai + base, an, a > b), (b, bi + low, bn, b >= a)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["ord", "start", "n", "later"])

    return run


def passage_spans(found: DataFrame, texts: DataFrame, least: int = MIN_PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """``ord, start, n, later``: verified passages of chains, at both of their places, from the pieces of texts."""
    given = lambda c: texts.select(F.col("ord").alias(c), F.col("start"), F.col("n"), F.col("words"))
    cut = found.select("a", "b", "chain", F.explode("blocks").alias("start"), F.lit(BLOCK).alias("n"))
    first = cut.join(given("a"), ["a", "start", "n"]).groupBy("a", "b", "chain").agg(F.collect_list(F.struct("start", "words")).alias("parts"))
    second = given("b").withColumnsRenamed({"start": "low", "n": "size"})
    work = found.drop("blocks").join(first, ["a", "b", "chain"]).join(second, ["b", "low", "size"])
    return work.select("a", "b", "a_at", "b_at", "low", "words", "parts").mapInArrow(_verified(least, similarity), "ord long, start int, n int, later boolean")


# Passages whose places other texts share too


#: What stands outside of a text that asks, and of one that is asked: no words, and never equal.
OUTSIDE = 0xFFFFFFFF, 0xFFFFFFFE

def _differs(differ: np.ndarray, since: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first place that differs, from a place of its own on; the width if there is none."""
    if since is not None:
        differ = differ & (np.arange(differ.shape[1]) >= since[:, None])
    first = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(first)), first], first, differ.shape[1])


def _beyond(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in common from the first ones on, row by row: how many are equal, and how many words of the first and of
    the second the longest way over one edit (a word replaced, more or fewer) takes."""
    width = x.shape[1]
    level = x != y
    plain = _differs(level)
    at = np.minimum(plain + 1, width)
    ways = [_differs(level, at) - at]
    at = np.minimum(plain, width - 1)
    for mine, other in ((x[:, 1:], y[:, :-1]), (x[:, :-1], y[:, 1:])):
        ways.append(_differs(mine != other, at) - at)
    ways = np.stack(ways)
    best = np.argmax(ways, axis=0)
    more = ways[best, np.arange(len(x))]
    step = lambda words: plain + np.where(more > 0, more + np.array(words)[best], 0)
    return plain, step((1, 1, 0)), step((1, 0, 1))


def around(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words around a common place to the longest passage with at most one edit: how many words lie before
    and behind the place's shingle, in the first and in the second."""
    right, left = REACH + LONG_SHINGLE, REACH
    r, rx, ry = _beyond(x[:, right:], y[:, right:])
    b, bx, by = _beyond(x[:, left - 1 :: -1], y[:, left - 1 :: -1])
    ahead = b + rx >= bx + r  # the edit lies behind the place
    pick = lambda yes, no: np.where(ahead, yes, no)
    return pick(b, bx), pick(rx, r), pick(b, by), pick(ry, r)


def _framed(words: pa.Array, offsets: np.ndarray, nothing: int) -> np.ndarray:
    """Words around places, the places one below the other; what lies outside of a text equals nothing."""
    out = np.full((len(words), 2 * REACH + LONG_SHINGLE), nothing, dtype=np.uint32)
    n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    first = np.repeat(REACH - offsets - (np.cumsum(n) - n), n)
    own = np.frombuffer(b"".join(words.to_pylist()), dtype="<u4")
    out[np.repeat(np.arange(len(n)), n), first + np.arange(int(n.sum()))] = np.minimum(own, np.uint32(min(OUTSIDE) - 1))
    return out


def _shingled(frame: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The hashed shingles of some rows of words, at each place."""
    words = frame[rows].astype(np.uint64)
    out = np.zeros((len(rows), words.shape[1] - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = _mixed(out + words[:, k : k + out.shape[1]])
    return dict(zip(rows.tolist(), out, strict=True))


def _equal_pairs(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of keys, several in each, to pairs of rows that are equal in one key at least: those of the same first row
    together, a bounded number of pairs or those of one row at a time."""
    orders = [np.argsort(k, kind="stable") for k in y.T]
    ends = [[np.searchsorted(k[o], c, side=s) for s in ("left", "right")] for k, o, c in zip(y.T, orders, x.T, strict=True)]
    part = np.cumsum(sum(high - low for low, high in ends)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(x)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        found = []
        for (low, high), order in zip(ends, orders, strict=True):
            n = (high - low)[a:b]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(np.arange(a, b), n) * len(y) + order[np.repeat(low[a:b], n) + within])
        both = np.unique(np.concatenate(found))
        yield both // len(y), both % len(y)


_PARTNERS = "place long, earlier boolean, score int, other long, before int, behind int, other_before int, other_behind int"


def _partners(least: int, similarity: float):
    """Sorted groups of places that ask and of places that are asked to the best partner of each that asks, among
    earlier places and among later ones."""

    def verified(x: np.ndarray, y: np.ndarray, span: tuple[int, ...]) -> bool:
        lx, rx, ly, ry = span
        end = REACH + LONG_SHINGLE - SHINGLE + 1
        a, b = set(x[REACH - lx : end + rx].tolist()), set(y[REACH - ly : end + ry].tolist())
        common = len(a & b)
        return common >= similarity * (len(a) + len(b) - common)

    def best(keys: list[np.ndarray], places: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        # The run of equal words around one of a passage's places has 25 words: eight of one side at least.
        sides = slice(REACH + LONG_SHINGLE, REACH + LONG_SHINGLE + SIDE), slice(REACH - SIDE, REACH)
        named = []
        for key, frame in zip(keys, (x, y), strict=True):
            both = [key.view(np.uint64)] * 2
            for k in range(SIDE):
                both = [_mixed(h + frame[:, s][:, k].astype(np.uint64)) for h, s in zip(both, sides, strict=True)]
            named.append(np.stack(both, axis=1))
        for i, j in _equal_pairs(*named, 1 << 17):
            i, j = (v[places[0][i] != places[1][j]] for v in (i, j))
            spans = np.empty((4, len(i)), np.int64)
            for k in range(0, len(i), 4096):
                own = slice(k, k + 4096)
                spans[:, own] = around(x[i[own]], y[j[own]])
            score = np.maximum(spans[0] + spans[1], spans[2] + spans[3]) + LONG_SHINGLE
            earlier = places[1][j] < places[0][i]
            good = np.flatnonzero(score >= least)
            good = good[np.lexsort((places[1][j[good]], -score[good], earlier[good], i[good]))]
            # Equal as a whole unless a word within the span differs.
            column = np.arange(x.shape[1])
            within = (column >= REACH - spans[0, good, None]) & (column < REACH + LONG_SHINGLE + spans[1, good, None])
            edited = ((x[i[good]] != y[j[good]]) & within).any(axis=1)
            given, other = (_shingled(frame, np.unique(v[good[edited]])) for frame, v in ((x, i), (y, j)))
            name = i[good] * 2 + earlier[good]
            cuts = [*np.flatnonzero(np.diff(name, prepend=-1)).tolist(), len(name)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                for g, differs in zip(good[low:high].tolist(), edited[low:high].tolist(), strict=True):
                    span = spans[:, g].tolist()
                    if not differs or verified(given[i[g]], other[j[g]], tuple(span)):
                        yield (int(places[0][i[g]]), bool(earlier[g]), int(score[g]), int(places[1][j[g]]), *span)
                        break

    def done(group: pa.Table) -> Iterator[pa.RecordBatch]:
        key, place, asks, off = (group.column(c).to_numpy() for c in ("key", "place", "asks", "off"))
        words = group.column("words").combine_chunks()
        of = [np.flatnonzero(asks == yes) for yes in (True, False)]
        found: list[tuple] = []
        if len(of[0]) and len(of[1]):
            x, y = (_framed(words.take(pa.array(at)), off[at].astype(np.int64), nothing) for at, nothing in zip(of, OUTSIDE, strict=True))
            found += best([key[at] for at in of], [place[at] for at in of], x, y)
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), *[pa.int32()] * 4)
        names = [c.split()[0] for c in _PARTNERS.split(", ")]
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return _by_group(done)


def open_places(units: DataFrame, shared: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """``h, place, open``: all places of the band keys that have three places or more and an open one.

    A place is open unless it lies within a passage that is known, and known to be a later copy if the place isn't the
    first one of its key.
    """
    end = F.col("start") + F.col("n")
    known = spans.where(F.col("n") >= least).select("ord", "start", end.alias("end"), F.when(F.col("later"), end).otherwise(0).alias("gone"))
    # Of two places only, each has met the other.
    some = units.where(F.col("kind").isin(SLIDING, AGAIN)).join(shared.where("n > 2").select("h", "first"), "h")
    none = F.lit(None).cast("long")
    rows = some.select("ord", "start", F.lit(0).alias("end"), F.lit(0).alias("gone"), "h", "first").union(known.select("*", none.alias("h"), none.alias("first")))
    reached = lambda c: F.max(c).over(Window.partitionBy("ord").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    short = lambda c: F.col(c) < F.col("start") + LONG_SHINGLE
    seen = rows.withColumns({"end": reached("end"), "gone": reached("gone")}).where("h is not null")
    asks = short("end") | (short("gone") & (_place() != F.col("first")))
    flagged = written(seen.select("h", _place().alias("place"), asks.alias("open")), "places")
    return flagged.join(flagged.where("open").select("h").distinct(), "h", "left_semi")


def asked(places: DataFrame, bound: int = ASKED) -> DataFrame:
    """Places (``h, place, open, n, off, words``; ``n``: how many its key has) in groups in which each open place asks all others of its key.

    Keys of over ``bound`` places are dealt anew by the eight words before and behind, one of which a pair must share;
    what is still larger is asked block by block.
    """
    cut = lambda at: F.expr(f"substring(words, {at}, {4 * SIDE})")
    sides = [F.when(F.length(w) == 4 * SIDE, F.xxhash64("h", F.lit(i), w)) for i, w in enumerate((cut(f"4 * (off + {LONG_SHINGLE}) + 1"), F.when(F.col("off") >= SIDE, cut(f"4 * (off - {SIDE}) + 1"))))]
    keyed = places.withColumn("key", F.explode(F.when(F.col("n") <= bound, F.array("h")).otherwise(F.array(*sides)))).where("key is not null").drop("h", "n")
    keyed = written(keyed, "asked")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("open").alias("u")).where("n > 1 and u > 0")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / bound)).cast("int")
    groups = groups.select("key", blocks("u").alias("asking"), blocks("n").alias("blocks"))
    both = keyed.join(groups, "key")
    mine = lambda c: F.pmod(F.xxhash64("place"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = both.where("open").withColumn("x", mine("asking")).withColumn("y", every("blocks")).withColumn("asks", F.lit(True))
    rows = asks.union(both.withColumn("y", mine("blocks")).withColumn("x", every("asking")).withColumn("asks", F.lit(False)).select(asks.columns))
    return rows.select(F.xxhash64("key", "x", "y").alias("key"), "place", "asks", "off", "words")


def missed_spans(
    units: DataFrame, shared: DataFrame, spans: DataFrame, texts: DataFrame, least: int = MIN_PASSAGE, similarity: float = SIMILARITY, bound: int = ASKED
) -> DataFrame:
    """``ord, start, n, later``: passages of open places, at both of their places.

    A passage whose parts stand in many other texts may not meet its copy among the ends of its bands. So each place
    that no known passage covers is compared with all other places of its key: words around both are followed over
    one edit, which passages of some 50 words can have, and longer ones in every such part.
    """
    places = open_places(units, shared, spans, least)
    low = F.greatest(F.lit(0), F.col("start") - REACH)
    at = written(places.select("h", "place", "open", *_unplaced("place")).select("*", low.alias("low"), (F.col("start") + REACH + LONG_SHINGLE - low).alias("size")), "around")
    given = pieces(texts, at.select("ord", F.col("low").alias("start"), F.col("size").alias("n")))
    given = given.withColumnsRenamed({"start": "low", "n": "size"})
    sizes = at.groupBy("h").agg(F.count("*").alias("n"))
    rows = asked(at.join(sizes, "h").join(given, ["ord", "low", "size"]).select("h", "place", "open", "n", (F.col("start") - F.col("low")).alias("off"), "words"), bound)
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_partners(least, similarity), _PARTNERS)
    order = F.struct("score", (-F.col("other")).alias("least"), "other", "before", "behind", "other_before", "other_behind")
    best = written(found.groupBy("place", "earlier").agg(F.max(order).alias("x")).select("place", "earlier", "x.*"), "partners")
    span = lambda place, before, behind, later: best.select(*_unplaced(place), before, behind, later.alias("later")).select(
        "ord", (F.col("start") - F.col(before)).alias("start"), (F.col(before) + LONG_SHINGLE + F.col(behind)).alias("n"), "later"
    )
    return span("place", "before", "behind", F.col("earlier")).union(span("other", "other_before", "other_behind", ~F.col("earlier")))


def merged(spans: DataFrame, least: int) -> DataFrame:
    """``ord, spans``: each text's spans, those that touch or overlap as one, of at least so many words."""
    own = Window.partitionBy("ord").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("new", F.when(F.col("start") > before, 1).otherwise(0))
    runs = cut.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("ord", "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"))
    return runs.where(F.col("n") >= least).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_passage: int = MIN_PASSAGE
) -> DataFrame:
    """``rid, doc_id, starts, lengths, removed_starts, removed_lengths``: passages that have another place, and the
    parts of them that aren't their earliest one, each of at least so many words.

    Earliest is by doc_id (nulls first), then by text hash, then by place. Of equal texts one is compared, and the
    others repeat it as a whole. A passage may repeat within its own text too. Null and empty texts, and texts without
    such a passage, have no row; rows equal in id and text are one; an empty table gives no rows; further columns
    are ignored. Texts of any length are compared as a whole.
    """
    rows = with_rid(docs, id_col, text_col)
    ids = written(rows.where("text is not null").select("rid", "doc_id", F.xxhash64("text").alias("tid")).distinct(), "ids")
    firsts = ids.groupBy("tid").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("copies")).select("tid", "first.*", "copies")
    known = written(numbered(firsts.withColumn("all", F.lit(0)), "all", ["doc_id", "rid"], "ord").select("tid", "rid", "ord", "copies"), "known")
    texts = rows.select("rid", "text").join(small(known.select("rid", "ord"), known.count()), "rid")
    units = written(texts.select("ord", "text").mapInArrow(_units(*bands(similarity, least=ROWS)), _UNITS), "units")
    met, lines = colliding_lines(units)
    keys = shared_keys(units)
    shared = chains(units, keys)
    wanted = lines.select("ord", "start", "n").union(shared.select("b", "low", "size"))
    wanted = wanted.union(shared.select("a", F.explode("blocks"), F.lit(BLOCK)))
    given = written(pieces(texts, wanted), "pieces")
    sets = written(lines.join(given, ["ord", "start", "n"]).select("h", "places", "words").mapInArrow(_sets, _SETS).dropDuplicates(["h"]), "sets")
    spans = line_spans(units, line_links(met, sets, similarity)).union(passage_spans(shared, given, min_passage, similarity))
    several = known.where("copies > 1").select("ord")
    whole = units.where(F.col("kind") == TEXT).join(several, "ord").select("ord", "start", "n", F.lit(False).alias("later"))
    spans = written(spans.distinct(), "known_spans")
    spans = written(spans.union(whole).union(missed_spans(units, keys, spans, texts, min_passage, similarity)).distinct(), "spans")
    every = merged(spans, min_passage).withColumnRenamed("spans", "r")
    gone = merged(spans.where("later"), min_passage).withColumnRenamed("spans", "g")
    length = whole.select("ord", "n").distinct()
    none = F.array().cast("array<struct<start:int,n:int>>")
    own = ids.join(known.withColumnRenamed("rid", "first_rid"), "tid").join(every, "ord").join(gone, "ord", "left").join(length, "ord", "left")
    removed = F.when(F.col("rid") == F.col("first_rid"), F.coalesce("g", none)).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("n"))))
    return own.withColumn("g", removed).select(
        "rid", "doc_id", F.col("r.start").alias("starts"), F.col("r.n").alias("lengths"), F.col("g.start").alias("removed_starts"), F.col("g.n").alias("removed_lengths")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents: repeated passages in words, and those that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated_passages(docs).drop("doc_id")
    rows = with_rid(docs, "doc_id", "text").select("doc_id", "rid").join(found, "rid", "left")
    none = F.array().cast("array<int>")
    words = lambda c: F.aggregate(F.coalesce(c, none), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        words("lengths").alias("n_repeated_words"), words("removed_lengths").alias("n_removed_words"),
        *[F.coalesce(c, none).alias(c) for c in ("starts", "lengths", "removed_starts", "removed_lengths")],
    )
