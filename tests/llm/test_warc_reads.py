"""How much of a package is read for its records."""

import pytest

from tallyweave.llm import warc


@pytest.mark.parametrize("size, n", [(600, 3000), (4000, 2500), (1_500_000, 4), (10, 1)])
def test_bytes_read_follow_the_archive(tmp_path, size, n):
    records = [(k, warc.record("response", k, f"http://h/{k}", bytes([65 + k % 26]) * (size + k % 7), None)) for k in range(n)]
    path = f"file://{tmp_path}/p.wacz"
    total = warc.write_package(path, records)
    ranges = warc.FileRanges(path)
    read, at = [], ranges.file.read_at
    ranges.file = type("Counted", (), {"read_at": lambda self, length, offset: (read.append(length), at(length, offset))[1]})()
    found = list(warc.read_package(ranges, total))
    assert [r[0] for r in found] == list(range(n)) and all(r[1] == size + k % 7 and r[3] == "response" for k, r in enumerate(found))
    assert sum(read) <= 1.2 * total + 4 * warc.BLOCK and len(read) <= 12 + total // warc.BLOCK * 2
    assert sum(read) <= 1.2 * total + 2 * warc.LARGEST_END + warc.BLOCK or size > warc.BLOCK


def test_records_are_read_in_the_order_of_their_ranges(tmp_path):
    records = [(k, warc.record("response", k, None, b"x" * 50, None)) for k in range(5)]
    out = []
    warc.pack_records(out.append, records)
    raw = b"".join(out)
    reads = []
    list(warc.read_package(lambda at, n: (reads.append(at), raw[at : at + n])[1], len(raw)))
    assert reads[-5:] == sorted(reads[-5:])
