import numpy as np
import pytest

from strophe.sources import containers


@pytest.mark.parametrize("text", ["a", "[00:01.00]words\n[00:02.00]words", "中文 " * 500])
def test_containers_round_trip(text):
    assert containers.krc_text(containers.krc_bytes(text)) == (text, None)
    assert containers.qrc_text(containers.qrc_hex(text)) == text


@pytest.mark.parametrize("data, error", [(None, "InvalidInput"), (b"krc1", "InvalidInput"), (b"krc1garbage", "DecompressionFailed")])
def test_broken_containers(data, error):
    assert containers.krc_text(data) == (None, error)


def test_broken_hex_is_null():
    assert containers.qrc_text(None) is None
    assert containers.qrc_text("zz") is None
    assert containers.qrc_text("00" * 16) is None


def _published_keys(key):
    """Round keys by the published standard: bits from the left, the second half read in its place."""
    bits = np.unpackbits(np.frombuffer(key, np.uint8))
    c, d, out = bits[containers.KEY_C], bits[containers.KEY_D], []
    for shift in containers.SHIFTS:
        c, d = np.roll(c, -shift), np.roll(d, -shift)
        out.append(np.concatenate([c, d])[containers.COMPRESSION])
    return out


def test_cipher_equals_the_published_one_but_for_its_stated_changes(monkeypatch):
    """With plain byte order, the published boxes and key schedule, a pass gives the standard's worked example."""
    boxes = [list(b) for b in containers.BOXES]
    assert (boxes[1][23], boxes[3][53]) == (15, 10)
    boxes[1][23], boxes[3][53] = 14, 1
    monkeypatch.setattr(containers, "BOXES", boxes)
    monkeypatch.setattr(containers, "_bits", lambda blocks: np.unpackbits(blocks, axis=1))
    monkeypatch.setattr(containers, "_bytes", lambda bits: np.packbits(bits, axis=1))
    containers._box_bits.cache_clear()
    # Worked examples of the published cipher.
    for key, plain, coded in (("133457799BBCDFF1", "0123456789ABCDEF", "85E813540F0AB405"), ("0E329232EA6D0D73", "8787878787878787", "0000000000000000")):
        block = np.frombuffer(bytes.fromhex(plain), np.uint8)[None]
        keys = _published_keys(bytes.fromhex(key))
        done = containers.crypt(block, keys)
        assert done.tobytes().hex().upper() == coded
        assert containers.crypt(done, keys[::-1]).tobytes().hex().upper() == plain
    containers._box_bits.cache_clear()
