import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import flac as op


def texts():
    rnd = random.Random(2)
    out = [None, "", "a", "x" * 576, "x" * 577, "é" * 400, "\x00\x7f" * 700, "the and of to " * 3000]
    out += ["".join(rnd.choices("abcdefghij éü\n", k=rnd.randint(1, 4000))) for _ in range(20)]
    out += ["".join(chr(rnd.randint(1, 0x7FF)) for _ in range(3000)), "\U0001f600" * 500]
    out += ["".join(map(chr, (np.arange(5000) // 20 % 90 + 33).tolist()))]
    return out


def test_round_trip_and_digests(spark):
    rows = list(enumerate(texts())) + [(3, "x" * 576), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS id")
    stored = op.store(df)
    got = op.read_back(stored).collect()
    assert len(got) == len(rows)
    expected = {}
    for i, t in rows:
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        expected[i] = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected[r.doc_id]
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert all(r.media_bytes == len(media[r.doc_id]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].media_sha256 == by[2].media_sha256 and by[None].feature == by[2].feature
    assert op.store(df.limit(0)).count() == 0


def test_every_subframe_kind_is_used_and_blocks_are_seekable(spark):
    rnd = np.random.default_rng(1)
    n = 64 * 576
    waves = [np.full(n, 65), rnd.integers(0, 256, n), (100 + 60 * np.sin(np.arange(n) * 1.3)).round(), np.cumsum(rnd.integers(-1, 2, n)) % 100 + 50]
    data = [w.astype(np.uint8).tobytes() for w in waves]
    media = op.encode(data)
    back = op.decode(media)
    assert [b[0] for b in back] == data
    kinds = {k for b in back for k in b[2]}
    assert {0, 1} <= kinds and any(8 <= k < 13 for k in kinds) and any(k >= 32 for k in kinds)
    stored = spark.createDataFrame([(i, 0, m) for i, m in enumerate(media)], "doc_id long, n_bytes long, media binary")
    for r in op.pcm_blocks(stored).collect():
        m, d = media[r.doc_id], data[r.doc_id]
        assert m[r.byte_offset : r.byte_offset + 4] == b"\xff\xf8\x24\x02" and r.first_sample == r.block * 576
        assert bytes(r.pcm) == bytes(b ^ 0x80 for b in d[r.first_sample : r.first_sample + 576])
    for sample in (0, 5, 16 * 576, 40 * 576 + 3):
        first, at = op.seek(media[1], sample)
        assert first == sample // 576 // 16 * 16 * 576 and media[1].startswith(op.frame_header(first // 576), at)


@pytest.mark.parametrize("number", [0, 127, 128, 2047, 2048, 65535, 65536, (1 << 36) - 1])
def test_frame_numbers_are_coded_like_utf8(number):
    head = op.frame_header(number)
    if number < 0xD800 or 0xE000 <= number < 0x110000:
        assert head[4:-1] == chr(number).encode("utf-8", "surrogatepass")
    assert op.crc8(head) == 0


def test_damage_is_noticed():
    [media] = op.encode([b"some words and more words " * 100 + b"\xff" * (576 * 5 - 2600)])
    for at in (1, 20, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            op.decode([bytes(broken)])


def test_a_header_inside_a_frame():
    head = op.frame_header(1)
    data = (bytes([0, 255] * 100) + bytes(np.random.default_rng(3).integers(0, 256, 300).astype(np.uint8)) + bytes(b ^ 0x80 for b in head)).ljust(576, b"q") + b"z" * 576
    noise = np.random.default_rng(4).integers(0, 256, 576).astype(np.uint8).tobytes()
    data = noise[:300] + bytes(b ^ 0x80 for b in head) + noise[300 + len(head) :] + b"z" * 576
    [media] = op.encode([data])
    assert media.count(head) == 2
    assert op.decode([media])[0][0] == data


def test_escaped_partitions_are_read():
    import numpy as np

    rnd = np.random.default_rng(2)
    x = rnd.integers(-128, 128, op.BLOCK)
    # Fixed order 0, Rice method 0, two partitions: one escaped with 8 bits a residual, one escaped with none, and order 1 likewise.
    for order, width, values in ((0, 8, x), (0, 0, np.r_[x[: op.BLOCK // 2], np.zeros(op.BLOCK // 2, int)]), (1, 9, np.cumsum(rnd.integers(-1, 2, op.BLOCK)))):
        residual = np.diff(values, prepend=0)[1:] if order else values
        first, second = residual[: op.BLOCK // 2 - order], residual[op.BLOCK // 2 - order :]
        number = lambda v, n: format(int(v) & ((1 << n) - 1), f"0{n}b") if n else ""
        text = number((8 + order) << 1, 8) + (number(values[0], 8) if order else "") + "00" + "0001"
        text += "1111" + number(8, 5) + "".join(number(v, 8) for v in first) + "1111" + number(width, 5) + "".join(number(v, width) for v in second)
        text += "0" * (-len(text) % 8)
        body = int(text, 2).to_bytes(len(text) // 8, "big")
        got, _ = op.decode_frames([body, body])
        assert (got == values).all()


def test_seek_points_lead_to_blocks(spark):
    df = spark.createDataFrame([(1, "some text " * 3000), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in op.read_back(op.store(df)).collect()}
    blocks = {(r.doc_id, r.block): r for r in op.pcm_blocks(op.store(df)).collect()}
    assert got[1].blocks == -(-30_000 // op.BLOCK) and got[1].seek_points == -(-got[1].blocks // op.SEEK_FRAMES) and got[2].blocks == 1
    assert got[1].last_block_at == blocks[1, got[1].blocks - 1].byte_offset
    media = op.store(df).where("doc_id = 1").first().media
    spans = [(b.byte_offset + (b.block == 16), 0) for (d, _), b in sorted(blocks.items()) if d == 1]
    with pytest.raises(ValueError, match="seek point"):
        op._seek_points(bytes(media), spans)
