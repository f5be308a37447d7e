"""TTML: timed paragraphs and spans with mixed content, walked in an Arrow UDF (XML order is beyond expressions).

Paragraphs with timed spans are syllable lines, others plain lines; ``x-bg`` spans form the line under a line; agents
decide the side; translations go to lines by their key. Where several replacements or subtitles fit, the first in the
document counts.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.schemas import LEFT, PARSED, RIGHT, UNSPECIFIED

_BRACKETS = re.compile(r"\(([^()]*)\)|（([^（）]*)）")
_AFTER_OPEN = re.compile(r"([(（])\s+")
_BEFORE_CLOSE = re.compile(r"\s+([)）])")


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _flat(text: str) -> str:
    return text.replace("\r", "").replace("\n", "")


def _spaced(text: str) -> str:
    return " ".join(text.split())


def clock_ms(value: str | None) -> int | None:
    """Milliseconds of a clock value, halves away from zero."""
    if value is None:
        return None
    v = value.strip()
    v = v[:-1] if v[-1:] in ("s", "S") else v
    try:
        parts = v.split(":")
        if len(parts) > 3:
            seconds = float(v.replace(":", "."))
        else:
            seconds = 0.0
            for p in parts:
                seconds = seconds * 60 + float(p)
        ms = seconds * 1000
        return int(ms + 0.5) if ms >= 0 else -int(-ms + 0.5)
    except (ValueError, OverflowError):
        return None


class _Line:
    """A line while it is put together."""

    def __init__(self, syllables: list | None = None, text: str = "", start: int | None = None, end: int | None = None):
        self.syllables, self.text, self.start, self.end = syllables, text, start, end
        self.alignment, self.sub, self.translations = UNSPECIFIED, None, None

    def put_text(self, new: str) -> None:
        """New text: cut like the old one if it is as long in bytes, else in one piece."""
        new = _flat(new)
        if self.syllables is None:
            self.text = new
            return
        raw, sizes = new.encode(), [len(s[0].encode()) for s in self.syllables]
        if sum(sizes) == len(raw) > 0:
            at, parts = 0, []
            for n in sizes:
                parts.append(raw[at : at + n])
                at += n
            try:
                for s, p in zip(self.syllables, parts, strict=True):
                    s[0] = p.decode()
                return
            except UnicodeDecodeError:  # a cut inside a character
                pass
        if self.syllables:
            self.syllables = [[new, self.syllables[0][1], self.syllables[-1][2]]]

    def row(self, sub: bool = False) -> dict:
        timed = self.syllables is not None
        out = {
            "is_syllable": timed,
            "is_full": self.translations is not None,
            "text": "" if timed else self.text,
            "start_ms": None if timed else self.start,
            "end_ms": None if timed else self.end,
            "alignment": self.alignment,
            "syllables": [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in self.syllables] if timed else None,
            "translations": None if self.translations is None else list(self.translations.items()),
            "pronunciation": None,
        }
        return out if sub else out | {"sub_line": self.sub.row(True) if self.sub else None}


def _collect(node: ET.Element, main: list, back: list, behind: bool) -> None:
    """Syllables of timed spans; text between them belongs to the one before."""

    def add_text(text: str | None) -> None:
        target = back if behind else main
        if text and target and (t := _flat(text)):
            target[-1][0] += t

    add_text(node.text)
    for kid in node:
        if _local(kid.tag) == "span":
            is_back = behind or (_attr(kid, "role") or "").lower() == "x-bg"
            if (begin := _attr(kid, "begin")) is not None:
                start = clock_ms(begin)
                end = clock_ms(_attr(kid, "end"))
                if start is not None:
                    target, raw = back if is_back else main, _flat("".join(kid.itertext()))
                    if target:
                        lead = raw[: len(raw) - len(raw.lstrip())]
                        target[-1][0] += lead
                        raw = raw[len(lead) :]
                    if raw:
                        target.append([raw, start, start if end is None else end])
            else:
                _collect(kid, main, back, is_back)
        else:
            _collect(kid, main, back, behind)
        add_text(kid.tail)


def _side(agent: str | None, agents: list[tuple[str, str]]) -> str:
    if not agents:
        return UNSPECIFIED
    if len(agents) == 1:
        return LEFT
    kind = next((t for i, t in agents if i == (agent or "").strip()), None)
    if kind is None:
        return UNSPECIFIED
    kinds = [t for _, t in agents]
    if len(agents) == 2 and kinds[0] != kinds[1] and "person" in (k.lower() for k in kinds):
        return LEFT if kind.lower() == "person" else RIGHT
    peers = [i for i, t in agents if t == kind]
    return RIGHT if peers.index(agent.strip()) % 2 else LEFT


def _split_brackets(text: str) -> tuple[str, str | None, str]:
    """Text without its first bracket segment, that segment, and what is inside it."""
    text = _flat(text)
    m = _BRACKETS.search(text)
    if not m:
        return _spaced(text), None, ""
    return _spaced(text[: m.start()] + text[m.end() :]), m[0], _spaced(m[1] or m[2] or "")


def _replace(line: _Line, text: str) -> None:
    if not line.sub:
        line.put_text(_spaced(text))
        return
    main, segment, _ = _split_brackets(text)
    line.put_text(main)
    if segment is not None:
        line.sub.put_text(_BEFORE_CLOSE.sub(r"\1", _AFTER_OPEN.sub(r"\1", segment)))


def _subtitle(line: _Line, subtitles: list[tuple[str, str]]) -> None:
    texts: dict[str, str] = {}
    for lang, value in subtitles:
        lang = lang.strip()
        texts.setdefault("und" if not lang else "zh" if lang.lower().startswith("zh") else lang, value)
    if line.sub:
        under = {}
        for lang, value in texts.items():
            texts[lang], _, inside = _split_brackets(value)
            if inside:
                under[lang] = inside
        if under:
            line.sub.translations = under
    line.translations = texts


def parse_document(text: str | None) -> dict | None:
    """One document as a PARSED value; null for a null text; broken XML has no lines."""
    if text is None:
        return None
    out: dict = {"lyrics_type": "ttml", "sync_type": "SyllableSynced", "writers": None, "metadata": {}, "additional_info": {"type": "General", "attributes": []}, "lines": []}
    text = text.lstrip("﻿").strip()
    if not text:
        return out
    if "<!ENTITY" in text:  # no entity declarations: they can grow without bound
        out["sync_type"] = "Unknown"
        return out
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        try:  # undeclared prefixes are common
            names = {p for p in re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", text) if p not in ("xml", "xmlns") and f"xmlns:{p}=" not in text}
            root = ET.fromstring(re.sub(r"<(tt)\b", lambda m: m[0] + "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(names)), text, count=1))
        except ET.ParseError:
            out["sync_type"] = "Unknown"
            return out
    nodes = list(root.iter())
    if (meta := next((n for n in nodes if _local(n.tag) == "iTunesMetadata"), None)) is not None:
        if (lead := _attr(meta, "leadingSilence")) and lead.strip():
            out["additional_info"]["attributes"].append({"key": "leadingSilence", "value": lead})
        out["writers"] = [w for n in meta.iter() if _local(n.tag) == "songwriter" and (w := "".join(n.itertext()).strip())] or None
    told: dict[str, list[tuple[str, str, str]]] = {}
    for n in nodes:
        if _local(n.tag) == "translation":
            for x in n:
                if _local(x.tag) == "text" and (key := (_attr(x, "for") or "").strip()) and (value := _flat("".join(x.itertext())).strip()):
                    told.setdefault(key, []).append(((_attr(n, "type") or "").strip(), (_attr(n, "lang") or "").strip(), value))
    agents = [(i, (_attr(n, "type") or "").strip()) for n in nodes if _local(n.tag) == "agent" and (i := (_attr(n, "id") or "").strip())]
    by_line = by_syllable = False
    for p in (n for n in nodes if _local(n.tag) == "p"):
        main: list = []
        back: list = []
        _collect(p, main, back, False)
        if main:
            by_syllable, line = True, _Line(main)
        else:
            words, begin = _flat("".join(p.itertext())).strip(), clock_ms(_attr(p, "begin"))
            if not words or begin is None:
                continue
            by_line, line = True, _Line(None, words, begin, clock_ms(_attr(p, "end")))
        line.alignment = _side(_attr(p, "agent"), agents)
        if back:
            back[0][0] = _AFTER_OPEN.sub(r"\1", back[0][0])
            back[-1][0] = _BEFORE_CLOSE.sub(r"\1", back[-1][0])
            line.sub = _Line(back)
            line.sub.alignment = line.alignment
        known = told.get(_attr(p, "key") or "", [])
        if new := next((v for t, _, v in known if t.lower() == "replacement"), None):
            _replace(line, new)
        if subtitles := [(lang, v) for t, lang, v in known if t.lower() == "subtitle"]:
            _subtitle(line, subtitles)
        out["lines"].append(line.row())
    out["sync_type"] = "MixedSynced" if by_line and by_syllable else "LineSynced" if by_line else "SyllableSynced" if by_syllable else "Unknown"
    return out


def parse(c: Column) -> Column:
    """PARSED value of a TTML text."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    result = DataType.fromDDL(PARSED)
    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([parse_document(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, result)(c)
