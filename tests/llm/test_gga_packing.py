import random
import zlib

import numpy as np
from tests_llm_shared import frame
from tokenizers import Tokenizer

from echotrace.llm import gga_packing as G
from echotrace.llm.common import docs_of
from echotrace.llm.token_ids import tokenizer_path


def test_pieces_and_places(spark, edge_rows):
    docs = frame(spark, edge_rows)
    got = G.pack_documents(docs, tokenizer_path()).collect()
    lib = Tokenizer.from_file(tokenizer_path())
    want = sorted((i or 0, nr, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()))
                  for i, t, _ in edge_rows for ids in [lib.encode(t or "", add_special_tokens=False).ids + [1]]
                  for nr, at in enumerate(range(0, len(ids), 4096)))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in places.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert G.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_many_shards_meet_again(spark):
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(300, 700), 1000]) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = G.pack(rows, 1000, shard_pieces=300).collect()
    assert sorted(r.uid for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + lengths[r.uid]
    assert max(fill.values()) <= 1000
    assert len(fill) <= 1.01 * -(-sum(lengths) // 1000) + 1


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    length = [rng.randint(1, 500) for _ in range(200)]
    one, other = G.Packing(), G.Packing()
    G.best_fit(one, sorted(range(200), key=lambda p: -length[p]), length, 1000)
    G.best_fit(other, list(range(200)), length, 1000)
    for _ in range(20):
        child = G.crossover(one, other, length, 1000, rng)
        assert sorted(p for b in child.bins for p in b) == list(range(200))
        assert child.fill == [sum(length[p] for p in b) for b in child.bins] and max(child.fill) <= 1000
    found = G.evolve(length, 1000, [], rng)
    assert len(found.best.bins) <= len(one.bins) and found.crossovers >= 1 and found.migrants == 0
    later = G.evolve(length, 1000, [found.best, other], rng)
    assert len(later.best.bins) <= len(found.best.bins) and later.crossovers >= 1 and later.migrants == 1


def test_every_settled_bin_comes_from_crossover_and_migration(spark):
    got = G.pack_documents(docs_of(spark, "/root/testdata/sf0.01"), tokenizer_path()).collect()
    assert min(r.crossovers for r in got) >= 2 and min(r.migrants for r in got) >= 1
    assert len({r.sequence_id for r in got}) <= 221
    pieces = spark.createDataFrame([(i, 1 + i * 7919 % 900) for i in range(2000)], "uid long, length long")
    got = G.pack(pieces, 1000, shard_pieces=300).collect()  # several shards
    assert len({(r.sequence_id >> 56, (r.sequence_id >> 16) & 0xFFFF) for r in got}) > 3
    assert min(r.crossovers for r in got) >= 2 and min(r.migrants for r in got) >= 1


def test_many_tiny_pieces_end(spark):
    docs = frame(spark, [(i, None if i % 2 else "", "s") for i in range(10_000)])
    got = G.pack_documents(docs, tokenizer_path()).collect()
    assert sorted(r.doc_id for r in got) == list(range(10_000)) and {r.length for r in got} == {1}
    assert len({(r.sequence_id, r.offset) for r in got}) == 10_000 and max(r.offset for r in got) < 4096
    assert len({r.sequence_id for r in got}) == 3
    # full sequences settle at once, tiny pieces of several shards are left
    rows = spark.createDataFrame([(i, 100 if i < 40 else 1) for i in range(3000)], "uid long, length long")
    got = G.pack(rows, 100, shard_pieces=50).collect()
    assert sorted(r.uid for r in got) == list(range(3000))
    assert len({r.sequence_id for r in got}) <= 40 + 30 + 1
