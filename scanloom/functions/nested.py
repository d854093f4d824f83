"""Walks over JSON documents of any depth, in Arrow batches: what no fixed column expression can say."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from xml.sax.saxutils import escape


def parsed(text: str | None):
    """A JSON text with numbers kept digit by digit."""
    return json.loads(text, parse_float=Decimal) if text is not None else None


def dumped(value) -> str:
    """JSON text of a parsed value."""
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{dumped(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumped, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def plain(value) -> str | None:
    """A scalar as text, anything else as JSON; NULL stays."""
    return value if value is None or isinstance(value, str) else dumped(value)


def values_of(attribute: dict) -> list | None:
    value = attribute.get("Value")
    return value if value is None or isinstance(value, list) else [value]


def attributes(document) -> Iterator[tuple[str, str, dict]]:
    """(path, tag, attribute) of a dataset and of the items of its sequences; a sequence with values gives its items only."""
    work = [("", document)]
    while work:
        path, ds = work.pop()
        for tag, a in ds.items() if isinstance(ds, dict) else ():
            a = a if isinstance(a, dict) else {}
            values = values_of(a)
            if a.get("vr") == "SQ" and values is not None:
                here = f"{path}/{tag}" if path else tag
                work += [(f"{here}[{i}]", item) for i, item in enumerate(values)]
            else:
                yield path, tag, a


def xml_lines(document, breaks: bool) -> Iterator[str]:
    """Native-model lines of a dataset in tag order, items of sequences inside."""
    marks = {"\r": "&#13;", "\n": "&#10;"} if breaks else {}
    work: list = [iter(sorted(document.items()) if isinstance(document, dict) else ())]
    while work:
        entry = next(work[-1], None)
        if entry is None:
            work.pop()
        elif isinstance(entry, str):
            yield entry
        else:
            tag, a = entry
            vr = plain(a.get("vr")) if isinstance(a, dict) else None
            values = a.get("Value") if isinstance(a, dict) else None
            if vr is None or not isinstance(values, list):
                continue
            inner: list = [f'<DicomAttribute tag="{tag}" vr="{vr}">']
            for i, v in enumerate(values, 1):
                if vr == "SQ":
                    inner += [f'<Item number="{i}">', *(sorted(v.items()) if isinstance(v, dict) else ()), "</Item>"]
                else:
                    inner.append(f'<Value number="{i}">{escape(plain(v) or "", marks)}</Value>')
            work.append(iter([*inner, "</DicomAttribute>"]))
