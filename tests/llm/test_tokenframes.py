import base64
import os

import numpy as np
import pytest
import tiktoken
import xxhash
import zstandard

from cadence.llm import tokenframes

from .samples import odd_rows, table

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenframes.VOCABULARY), reason="no vocabulary file here")


def by_hand(data):
    """(id, numbers) of each document: the frames are found by their own magic numbers and ends, the table at the end is only compared."""
    frames, at = [], 0
    while data[at : at + 4] == (0xFD2FB528).to_bytes(4, "little"):
        d = zstandard.ZstdDecompressor().decompressobj()
        raw = d.decompress(data[at:])
        end = len(data) - len(d.unused_data)
        frames.append((end - at, raw))
        at = end
    assert data[at : at + 4] == (0x184D2A5E).to_bytes(4, "little") and at + 8 + int.from_bytes(data[at + 4 : at + 8], "little") == len(data)
    table = data[at + 8 : -9]
    for k, (size, raw) in enumerate(frames):
        entry = [int.from_bytes(table[12 * k + j : 12 * k + j + 4], "little") for j in (0, 4, 8)]
        assert entry == [size, len(raw), xxhash.xxh64(raw).intdigest() % 2**32]
    assert 12 * len(frames) == len(table) and int.from_bytes(data[-9:-5], "little") == len(frames)
    width, ids = frames[0][1][0], frames[0][1][1:]
    ids = [int.from_bytes(ids[i : i + 8], "little", signed=True) for i in range(0, len(ids), 8)]
    return [(i, [int.from_bytes(raw[j : j + width], "little") for j in range(0, len(raw), width)]) for i, (_, raw) in zip(ids, frames[1:], strict=True)]


def test_shards_read_by_hand():
    r = np.random.default_rng(4)
    for width, most in ((2, 60_000), (4, 200_000)):
        docs = [(int(r.integers(-(2**40), 2**40)), r.integers(0, most, n)) for n in (0, 1, 7, 5000, 3)]
        shard = tokenframes.ShardWriter(width)
        for i, tokens in docs:
            shard.add(i, tokens)
        assert by_hand(shard.finish()) == [(i, t.tolist()) for i, t in docs]


def coder():
    return tiktoken.Encoding("t", pat_str=tokenframes.PATTERN, mergeable_ranks=tokenframes.load_ranks(tokenframes.VOCABULARY), special_tokens={})


@needs_vocabulary
def test_round_trip(spark):
    rows = odd_rows() + [(30, "<|endoftext|> is text")]
    docs = table(spark, rows)
    shards = tokenframes.encode(docs, shard_bytes=200).collect()
    assert len(shards) > 1
    known, back = coder(), []
    for r in shards:
        reader = tokenframes.ShardReader(bytes(r["data"]))
        assert reader.ids.tolist() == r["doc_ids"]
        back += [(i, known.decode(x.tolist()), len(x)) for i, x in reader.read(r["doc_ids"])]
        assert [x[2] for x in back[-len(r["doc_ids"]) :]] == r["n_tokens"]
    assert sorted((i, t) for i, t, _ in back) == sorted((i, t or "") for i, t in rows if i is not None)


@needs_vocabulary
def test_only_requested_frames_are_read_and_damage_is_seen(spark):
    docs = table(spark, [(i, f"document number {i} " * 20) for i in range(50)]).coalesce(1)
    (row,) = tokenframes.encode(docs).collect()
    data = bytes(row["data"])
    reader = tokenframes.ShardReader(data)
    assert [i for i, _ in reader.read([7, 31, 999])] == [7, 31] and reader.decompressed == 3
    # any zstandard reader skips the table and gets all frames
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert len(whole) == reader.table[:, 1].sum()
    hurt = bytearray(data)
    hurt[-9 - 12 * 20 + 8] ^= 1  # one checksum
    bad = tokenframes.ShardReader(bytes(hurt))
    with pytest.raises(ValueError):
        list(bad.read(range(50)))
    with pytest.raises(ValueError):
        tokenframes.ShardReader(data[:-1])


@needs_vocabulary
def test_files(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}") for i in range(20)])
    for _ in range(2):
        done = tokenframes.write_files(tokenframes.encode(docs), str(tmp_path / "out")).collect()
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == sorted(f"{r['shard']}.tok.zst" for r in done)
    assert tokenframes.encode(table(spark, [])).count() == 0


@needs_vocabulary
def test_vocabulary_file_is_a_parameter(spark, tmp_path):
    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)))
    (row,) = tokenframes.encode(table(spark, [(1, "ab é")]).coalesce(1), str(path)).collect()
    assert dict((i, x.tolist()) for i, x in tokenframes.ShardReader(bytes(row["data"])).read([1])) == {1: list("ab é".encode())}
