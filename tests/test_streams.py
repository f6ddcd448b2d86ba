"""Framing of sample streams: blocks that start anywhere, records that look like others, broken files."""

import random
import struct

import numpy as np
import pytest

from lumaprof.sources import streams


def header(kind, records):
    return struct.pack("<4sHHHHBBHQQQ", b"MPSP", kind, 1, 0, 40, 1, 1, 0, records, 0, 0)


def pmu_record(ip, chain, pad=0):
    size = 66 + 8 * len(chain) + pad
    return struct.pack("<HHIIIHHIIIQQQQH", 1, size, 0, 0, 2, 0, 0, 10, 11, 3, 1, 99, ip, 1000, len(chain)) + struct.pack(f"<{len(chain)}Q", *chain) + bytes(pad)


def spe_record(pc, pad=b""):
    return struct.pack("<HHIIIIIQQQIIQBBBHHQ", 2, 79 + len(pad), 0, 0, 10, 11, 3, 1, 100, pc, 7, 1, 3, 1, 1, 2, 7, 0, 0) + pad


def test_chains_of_a_block_equal_a_walk():
    random.seed(4)
    # Callers that look like the beginning of a record.
    odd = int.from_bytes(struct.pack("<HHI", 1, 66, 0), "little")
    records = [pmu_record(n, [random.choice([odd, 1, n]) for _ in range(random.randrange(6))], random.randrange(3)) for n in range(300)]
    body, starts = b"".join(records), np.cumsum([0, *map(len, records)])
    for at in range(0, len(body) - 2000, 997):
        chain = streams.Chain(body[at:at + 2000 + 128], 2000, len(body) - at, streams.PMU_KIND)
        inside = starts[(starts >= at) & (starts < at + 2000)] - at
        assert chain.from_entry(int(inside[0])).tolist() == inside.tolist()
        entry = int(np.searchsorted(chain.at, inside[0]))
        assert chain.counts[entry] == inside.size and chain.exits[entry] + at == starts[starts >= at + 2000][0]


@pytest.mark.parametrize("range_bytes", [64, 300, 5000, 1 << 20])
def test_records_of_many_sizes_are_read_whole(spark, tmp_path, range_bytes):
    random.seed(5)
    chains = [[random.choice([n, 0x00420001]) for _ in range(random.choice([0, 1, 3, 40]))] for n in range(400)]
    for name, kept in (("a", 400), ("b", 123)):
        body = b"".join(pmu_record(n, c) for n, c in enumerate(chains))
        (tmp_path / f"{name}.bin").write_bytes(header(1, kept) + body + b"tail")
    rows = streams.read_pmu(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")], range_bytes=range_bytes).collect()
    for name, kept in (("a", 400), ("b", 123)):
        assert sorted((r.ip, r.callchain) for r in rows if r.path.endswith(f"{name}.bin")) == [(n, chains[n]) for n in range(kept)]
    assert streams.stream_problems(spark, str(tmp_path), streams.PMU_KIND, range_bytes).count() == 0


def test_a_bad_record_in_the_middle_is_reported_with_its_offset(spark, tmp_path):
    good = [spe_record(n, bytes(n % 7)) for n in range(200)]
    at = 40 + sum(map(len, good[:120]))
    body = bytearray(header(2, 0) + b"".join(good))
    body[at + 2:at + 4] = struct.pack("<H", 3)
    (tmp_path / "bad.bin").write_bytes(bytes(body))
    (tmp_path / "short.bin").write_bytes(header(2, 0) + b"".join(good)[:-5])
    (tmp_path / "fine.bin").write_bytes(header(2, 0) + b"".join(good))
    (tmp_path / "none.bin").write_bytes(header(2, 0))
    found = {r.path.rsplit("/", 1)[1]: (r.offset, r.problem) for r in streams.stream_problems(spark, str(tmp_path), streams.SPE_KIND, 500).collect()}
    assert found == {"bad.bin": (at, "bad record"), "short.bin": (40 + sum(map(len, good[:-1])), "bad record")}
    with pytest.raises(Exception, match=f"bad record at byte {at}"):
        streams.read_spe(spark, str(tmp_path / "bad.bin"), range_bytes=500).collect()
    assert streams.read_spe(spark, [str(tmp_path / "fine.bin"), str(tmp_path / "none.bin")], range_bytes=500).count() == 200


def test_fewer_records_than_announced(spark, tmp_path):
    (tmp_path / "few.bin").write_bytes(header(1, 9) + pmu_record(1, [2]))
    (problem,) = streams.stream_problems(spark, str(tmp_path), streams.PMU_KIND).collect()
    assert (problem.offset, problem.problem) == (40 + 74, "truncated record")
