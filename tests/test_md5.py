"""MD5 in arrays against hashlib's."""

import hashlib

import pytest

from factloom.functions import md5


@pytest.mark.parametrize("head", [b"", b"1:2:", b"123:4:", b"None:10:", "é:".encode(), b"z" * 55, b"z" * 70])
def test_first_bytes_are_those_of_hashlib(head):
    """Texts of all lengths, some too long for one block, some alone with their length, in parts of any size."""
    texts = sorted([".", "", "é" * 30, "x" * 80, *["y" * n for n in range(45, 60)], *[f"<Customer#{i:09d}>" for i in range(50)], "<NATION_1>", "<NATION_2>"])
    want = [int.from_bytes(hashlib.md5(head + t.encode()).digest()[:4], "big") for t in texts]
    laid = md5.Texts(texts)
    for size in (1, 7, 1000):
        assert [x for at in range(0, len(texts), size) for x in laid.first(head, at, at + size).tolist()] == want
