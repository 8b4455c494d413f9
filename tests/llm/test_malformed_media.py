"""Files that aren't well formed give a reason, whatever is wrong with them."""

import random
import struct

import pytest

from quakeframe.llm import media, media_columns


def reason(data):
    try:
        media.probe_media(data)
    except ValueError as e:
        return str(e)
    return None


def test_deep_nesting():
    data = b""
    for _ in range(2000):
        data = media.box(b"moov", data)
    assert reason(data) == "boxes are nested too deep"


@pytest.mark.parametrize("kind, at, value", [(b"stsz", 8, 1 << 31), (b"stco", 4, 1 << 31), (b"stsc", 4, 1 << 31), (b"stss", 4, 1 << 31), (b"stts", 4, 1 << 31), (b"stsc", 8, 7), (b"stsc", 12, 0), (b"stsc", 12, 1 << 31), (b"stts", 8, 3), (b"stco", 8, 1 << 31)])
def test_numbers_that_are_too_large(kind, at, value):
    good = media.store_media(bytes(5000))
    where = good.index(kind) + 4 + at
    assert reason(good) is None and reason(good[:where] + struct.pack(">I", value) + good[where + 4 :]) is not None


def test_random_damage_never_ends_a_task(spark):
    rng = random.Random(4)
    good = media.store_media(bytes(range(256)) * 70)
    header = good.index(b"moov")
    damaged = [good, b"", good[:100]]
    for _ in range(3000):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(header, len(bad))] = rng.choice([0, 1, 127, 255, rng.randrange(256)])
        damaged.append(bytes(bad))
    df = spark.createDataFrame([(i, 1, d) for i, d in enumerate(damaged)] + [(None, None, None)], "doc_id long, n_bytes long, media binary")
    got = media_columns.read_media(df).collect()
    assert len(got) == len(damaged) + 1
    assert all((r.codec is None) == (r.error is not None) for r in got) and sum(r.error is not None for r in got) > 300
