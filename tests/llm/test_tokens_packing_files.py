import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logaudit.llm import huffman as H
from logaudit.llm import packing as P
from logaudit.llm.tokens import Encoder, default_path

ODD = [" ", " ", "\n", "a", "b", "'s", ".", "9", "\t", "\xa0", "é", "||", "\x00", "<|endoftext|>", "　", "Foo", "!!", "\x1c", "\x85", "'", ",", "ß."]
TEXTS = [None, "", "a", "A b", "x y " * 3000, "same text here", "same text here", "\n\n", " lead and trail ", "ümlaut straße"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


@pytest.mark.parametrize("alphabet", [ODD, ODD[:7], ["foo", " ", "a.", "b,", "\n", "'", "."]])
def test_encoder_equals_the_library(encoder, alphabet):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    got = [x.tolist() for ids, n in encoder.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [x.tolist() for x in encoder.whole(texts)]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n long".replace("n long", "part string"))


def ids(encoder, text, end):
    return encoder.whole([text or ""])[0].tolist() + [end]


def crc(x):
    return zlib.crc32(np.asarray(x, dtype="<u4").tobytes())


def test_packing_holds_every_id_once(spark, encoder):
    rows = P.pack(docs(spark)).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in [*enumerate(TEXTS), (None, "no id")]:
        want = ids(encoder, text, 1)
        copies = 2 if i == 3 else 1
        assert sum(r.length for r in by[i]) == copies * len(want)
        assert all(r.ids_crc32 == crc(want[r.start : r.start + r.length]) and r.doc_tokens == len(want) for r in by[i])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packer_pads_one_sequence_at_most():
    rnd = random.Random(1)
    packer = P.Packer()
    sizes = [rnd.choice([1, 5, 300, 700, 1500, 2048, 5000]) + rnd.randint(0, 40) for _ in range(3000)]
    for i, n in enumerate(sizes):
        packer.add(i, n)
        if len(packer.pool) > 500:
            packer.pack(100)
    packer.finish()
    filled, got = collections.Counter(), collections.Counter()
    for doc, _, length, sequence, _, _ in packer.out:
        filled[sequence] += length
        got[doc] += length
    assert [got[i] for i in range(len(sizes))] == sizes
    assert sum(n & (n - 1) != 0 for n in filled.values()) <= 1


def test_step_groups_are_balanced(spark):
    rows = P.stepped(P.written(spark.range(1000).selectExpr(
        "cast(id % 3 as int) part", "cast(if(id % 5 = 0, 512, 2048) as int) tier", "id sequence_id", "0L offset", "id doc_id", "0L start", "1L length", "0L ids_crc32", "1L doc_tokens"), "x"), 200_000)
    per = collections.Counter((r.step_group, r.tier) for r in rows.collect())
    for tier in (512, 2048):
        sizes = [n for (_, t), n in per.items() if t == tier]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n, limit", [(1, 5), (2, 5), (50, 6), (1000, 10), (50000, 16), (300, 20)])
def test_codes_are_complete_and_short(n, limit):
    counts = (np.random.default_rng(n).pareto(0.7, n) * 3 + 1).astype(np.int64)
    lengths = H.code_lengths(counts, limit)
    assert lengths.max() <= limit and (n == 1 or abs((0.5**lengths).sum() - 1) < 1e-9)


def test_blocks_decode_to_what_was_encoded():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(0.7, 5000) * 3 + 1).astype(np.int64)
    book = H.Book(np.arange(5000), H.code_lengths(counts))
    sizes = rng.integers(0, 700, 100)
    tokens = rng.choice(5000, int(sizes.sum()), p=counts / counts.sum())
    payload, _, marks = book.encode(tokens, sizes)
    assert (H.decode(book.table(), book.bits, payload, sizes, marks) == tokens).all()


def test_files_round_trip(spark, encoder, tmp_path):
    path = f"file://{tmp_path}/files"
    H.write(docs(spark), path)
    rows = sorted(H.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for r in rows:
        want = ids(encoder, "no id" if r.doc_id is None else TEXTS[r.doc_id], 0)
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_empty_tables(spark, tmp_path):
    none = docs(spark).limit(0)
    assert P.pack(none).count() == 0
    H.write(none, f"file://{tmp_path}/none")
    assert H.read(spark, f"file://{tmp_path}/none").count() == 0
