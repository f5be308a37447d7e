"""The UDFs of containers: equal values are decoded once, different ones together, each row gets its own text."""

import numpy as np
import pyarrow as pa
import pytest

from strophe.sources import containers

TEXTS = [f"[{i},10]word {i} 词(0,10)" * (1 + i % 7) for i in range(1200)]


@pytest.fixture
def calls(monkeypatch):
    """The UDFs as functions of Arrow arrays, and the blocks of each call of the cipher."""
    found, crypt = [], containers.crypt
    monkeypatch.setattr(containers.F, "arrow_udf", lambda run, kind: lambda values: run(values))
    monkeypatch.setattr(containers, "crypt", lambda blocks, keys: (found.append(len(blocks)), crypt(blocks, keys))[1])
    return found


def test_copies_are_decoded_once(calls):
    coded = containers.qrc_hex(TEXTS[0])
    calls.clear()
    assert containers.decode_qrc(pa.array([coded, None] * 2000)).to_pylist() == [TEXTS[0], None] * 2000
    assert len(calls) == 3 and sum(calls) == 3 * len(coded) // 16


def test_different_containers_go_together(calls):
    odd = [None, "", "zz", "00" * 16, "5FD4440BA022BF"]
    coded = [containers.qrc_hex(t) for t in TEXTS]
    calls.clear()
    assert containers.decode_qrc(pa.array(odd + coded + odd[::-1])).to_pylist() == [None] * 5 + TEXTS + [None] * 5
    assert len(calls) < 30 and max(calls) <= containers.BLOCKS
    assert containers.decode_qrc(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    assert containers.decode_qrc(pa.array([], pa.string())).to_pylist() == []


def test_more_blocks_than_go_at_once(monkeypatch):
    monkeypatch.setattr(containers, "BLOCKS", 3)
    datas = [bytes(np.arange(n, dtype=np.uint8)) for n in (1, 8, 50, 9, 64)]
    coded = [containers.crypt_bytes(d + b"\0" * (-len(d) % 8), decode=False) for d in datas]
    assert [p[: len(d)] for p, d in zip(containers.crypt_all(coded), datas, strict=True)] == datas
