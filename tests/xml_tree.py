"""Records of an XML document by a walk over its tree: what the table of nodes is held against."""

from __future__ import annotations

import xml.etree.ElementTree as ET


def _names(tags: str) -> list[str]:
    return [t.strip() for t in (tags or "").split(",") if t.strip()]


def _pairs(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in (text or "").split(",") if "=" in p)}


def _own(element: ET.Element) -> list[tuple[str, str]]:
    """An element's text under its tag, its attributes under tag@name."""
    text = (element.text or "").strip()
    return ([(element.tag, text)] if text else []) + [(f"{element.tag}@{k}", v) for k, v in element.attrib.items()]


def _gather(into: dict, element: ET.Element) -> None:
    for key, value in _own(element):
        into[key] = f"{into[key]}\n{value}" if key in into else value


class TreeRules:
    """The records of an XML document by walking its tree."""

    def __init__(self, main: str = "", prefix: str = "", suffix: str = "", everywhere: str = "", fixed: str = "", renamed: str = "", merge: bool = False):
        self.main, self.merge = main.strip(), merge
        self.prefix, self.suffix, self.everywhere = _names(prefix), _names(suffix), _names(everywhere)
        self.fixed, self.renamed = _pairs(fixed), _pairs(renamed)

    def records(self, text: str) -> list[dict[str, str]]:
        """The records of a document; ValueError if it is no XML or holds no main element."""
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            raise ValueError(f"not XML: {e}") from e
        mains = root.findall(f".//{self.main}") if self.main else list(root)
        if not mains:
            raise ValueError(f"no element {self.main!r}")
        number = {id(m): k for k, m in enumerate(mains, 1)}
        parents = [p for p in root.iter() if any(id(c) in number for c in p)]
        parents.sort(key=lambda p: min(number[id(c)] for c in p if id(c) in number))
        out: list[tuple[int, dict]] = []
        for parent in parents:
            out += self._merged(parent, number) if self.merge else self._single(parent, number)
        if self.merge:
            # Groups of leaf elements have no place of their own, so groups keep the order of their parents.
            return [{"id": str(k)} | r for k, (_, r) in enumerate(out, 1)]
        return [r for _, r in out]

    def _head(self, parent: ET.Element) -> dict[str, str]:
        found: dict[str, str] = {}
        for tag in self.everywhere:
            for e in parent.findall(f".//{tag}"):
                found |= dict(_own(e))
        return found | self.fixed

    def _renamed(self, record: dict) -> dict:
        return {self.renamed.get(k, k): v for k, v in record.items()}

    def _whole(self, element: ET.Element) -> dict:
        """An element with all below it; later ones of a tag overwrite earlier ones, attributes come before texts."""
        found = dict(sorted(_own(element), key=lambda kv: "@" not in kv[0]))
        for child in element:
            found |= self._whole(child)
        return found

    def _single(self, parent: ET.Element, number: dict) -> list[tuple[int, dict]]:
        children = list(parent)
        places = [k for k, c in enumerate(children) if id(c) in number]
        out = []
        for n, at in enumerate(places):
            before = children[places[n - 1] + 1 if n else 0 : at]
            # What follows the last main element belongs to none.
            after = children[at + 1 : places[n + 1]] if n + 1 < len(places) else []
            record = {"id": str(number[id(children[at])])} | self._head(parent)
            for tags, part in ((self.prefix, before), (None, []), (self.suffix, after)):
                if tags is None:
                    record |= self._whole(children[at])
                    continue
                found: dict[str, str] = {}
                for c in part:
                    if c.tag in tags:
                        _gather(found, c)
                record |= found
            out.append((number[id(children[at])], self._renamed(record | self.fixed)))
        return out

    def _merged(self, parent: ET.Element, number: dict) -> list[tuple[int, dict]]:
        """Runs of main elements as one record; a prefix tag with text ends a run."""
        out: list[tuple[int, dict]] = []
        head, texts, tail, first = {}, [], {}, None

        def close() -> None:
            nonlocal head, texts, tail, first
            if texts:
                out.append((first or 0, self._renamed(self._head(parent) | head | {self.main or "text": "\n".join(texts)} | tail)))
                head, texts, tail, first = {}, [], {}, None

        for c in parent:
            text = (c.text or "").strip()
            if id(c) in number:
                first = first or number[id(c)]
                texts += [text] if text else []
            elif text and c.tag in self.prefix:
                close()
                _gather(head, c)
            elif text and c.tag in self.suffix:
                _gather(tail, c)
        close()
        return out
