"""Token ids of a byte-level BPE with word ends, for whole batches of words at once.

The merges and the vocabulary come from the tokenizer's own file. Texts are cut at white space; each distinct piece of
a batch is looked up once in a bounded cache and encoded where it is not there. Pieces of ordinary characters (ASCII, Latin-1, Latin Extended-A) are cut by
the file's own pattern and their words go through tiktoken's merge loop in one call: a word ends with a mark that first
of all joins its last byte, which makes that byte the vocabulary's word-final symbol. Merging by the rank of the joined
bytes equals merging by the file's pairs, as every token, merged on its own with the ranks below it, ends as exactly its
own pair (``consistent()``, a test). All other pieces, and texts with characters on which the white space rules differ,
go through the tokenizers library itself. A few pieces of every batch are encoded by the library, too, and compared.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept, about 250 bytes each.
CACHE = 600_000
_MARK = "\x01"
_SIMPLE = regex.compile(r"[\x21-\x7E¡-¬®-ſ]+")
_ALL_SIMPLE = regex.compile(r"[\n\x21-\x7E¡-¬®-ſ]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Texts without these characters are lowered and cut by Arrow; others keep what the library's normalization may need.
_ODD = regex.compile(r"[^\x00-\x1B\x20-\x7E¡-¬®-ſ]")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder for one tokenizer file (BPE, byte level, a suffix on the last symbol of each word)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        mark = _MARK.encode()

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return b"".join([back[c] for c in body]) + (mark if token != body else b"")

        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        #: Rank of each byte string; single bytes come first, then word-final bytes, then the merges in order.
        self.rank = {bytes([b]): b for b in range(256)}
        ids = [vocab[c] for c in chars]
        for b, c in enumerate(chars):
            self.rank[bytes([b]) + mark] = len(ids)
            ids.append(vocab[c + end])
        self.pairs: list[tuple[bytes, bytes]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.append((raw(a), raw(b)))
            if (x := raw(a) + raw(b)) not in self.rank:
                self.rank[x] = len(ids)
                ids.append(vocab[a + b])
        self.ids = np.array(ids, "<u4")
        self.final = np.zeros(len(ids), bool)
        self.final[[r for x, r in self.rank.items() if x.endswith(mark) and len(x) > 1]] = True
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=self.rank, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def consistent(self) -> bool:
        """Whether each pair of the file is what its token comes to just before the token's own merge."""
        for a, b in self.pairs:
            top = self.rank[a + b]
            parts = [bytes([x]) for x in a + b]
            while True:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1], top)) < top]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if parts != [a, b]:
                return False
        return True

    def _learn(self, pieces: list[str]) -> None:
        """Encode unseen pieces into the cache, as little-endian unsigned 32-bit ids."""
        simple, other, lines = pieces, [], "\n".join(pieces)
        if not _ALL_SIMPLE.fullmatch(lines) or "<|" in lines:
            simple = [p for p in pieces if _SIMPLE.fullmatch(p) and "<|" not in p]
            other, lines = list(set(pieces).difference(simple)), "\n".join(simple)
        if other:
            for p, e in zip(other, self.library.encode_batch(other, add_special_tokens=False), strict=True):
                self.cache[p] = np.array(e.ids, "<u4").tobytes()
        if not simple:
            return
        low = lines.lower().split("\n")
        cut = {p: self.pattern.findall(p) for p in low if not p.isalpha()}
        words = list({p for p in low if p not in cut}.union(*cut.values()))
        made = np.array(self.merge(f"{_MARK}\n".join([*words, ""])), np.int64)
        stops = ((np.flatnonzero(self.final[made]) + 1) * 4).tolist()
        if len(stops) != len(words):
            raise ValueError("a word has no end")
        data = self.ids[made].tobytes()
        ids = {w: data[at:to] for w, at, to in zip(words, [0, *stops], stops)}  # noqa: B905
        for p, x in zip(simple, low, strict=True):
            self.cache[p] = b"".join([ids[w] for w in cut[x]]) if x in cut else ids[x]
        for p in simple[:: max(1, len(simple) // 8)]:
            want = np.array(self.library.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
            if want != self.cache[p]:
                raise ValueError(f"the tokenizers library encodes {p!r} otherwise")

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        out = list(map(self.cache.get, pieces))
        if new := [i for i, x in enumerate(out) if x is None]:
            self._learn([pieces[i] for i in new])
            for i in new:
                out[i] = self.cache[pieces[i]]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without odd characters: each distinct piece is looked up once, ids are gathered by numpy."""
        pieces = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        flat = pieces.flatten().dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py()
        ids = self._known(lines.split("\n"))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        at = flat.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[take].tobytes()
        stops = (4 * ends[pieces.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in itertools.pairwise(stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        odd = [_ODD.search(t) is not None for t in texts]
        plain = iter(self._plain([t for t, x in zip(texts, odd, strict=True) if not x]) if not all(odd) else ())
        out = []
        for t, x in zip(texts, odd, strict=True):
            if not x:
                out.append(next(plain))
            elif _SEPARATORS.search(t):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                pieces = t.split()
                known = dict(zip(distinct := list(set(pieces)), self._known(distinct), strict=True))
                out.append(b"".join([known[p] for p in pieces]))
        return out
