"""Blocks to editable markup and back."""

from __future__ import annotations

import re

from ..operators.pages import FIELD, joined


def to_markup(blocks: list[dict]) -> str:
    def one(b: dict) -> str:
        if b["type"] == "heading":
            return "#" * b["level"] + " " + b["text"]
        if b["type"] == "list":
            mark = {"checklist": lambda i, k: "[x] " if i.get("checked") else "[ ] ", "ordered": lambda i, k: f"{i.get('number') or k}. ", "bullet": lambda i, k: "- "}[b["style"]]
            return "\n".join(mark(i, k) + i["text"] for k, i in enumerate(b["items"], 1))
        if b["type"] == "fields":
            return "\n".join(f"{f['label']}: {f['value']}" for f in b["items"])
        return b["text"]

    return "\n\n".join(map(one, blocks))


_ITEMS = (("checklist", re.compile(r"^\[( |x|X)?\]\s*(.+)$")), ("ordered", re.compile(r"^(\d{1,3})[.)]\s+(.+)$")), ("bullet", re.compile(r"^()[-*•]\s+(.+)$")))


def parse_markup(markup: str | None) -> list[dict]:
    """Inverse of :func:`to_markup`; an empty line ends a block."""
    blocks: list[dict] = []
    current: dict | None = None

    def into(kind: dict, text: str | None = None) -> dict:
        nonlocal current
        if current is None or any(current.get(k) != v for k, v in kind.items()):
            current = kind | ({"text": text} if text is not None else {"items": []})
            blocks.append(current)
        elif text is not None:
            current["text"] = joined(current["text"], text)
        return current

    for line in (x.strip() for x in re.split(r"\r?\n", markup or "")):
        if not line:
            current = None
        elif m := re.match(r"^(#{1,3})\s+(.+)$", line):
            current = None
            blocks.append({"type": "heading", "level": len(m[1]), "text": m[2].strip()})
        elif hit := next(((style, m) for style, p in _ITEMS if (m := p.match(line))), None):
            style, m = hit
            item = {"text": m[2]} | ({"checked": bool((m[1] or "").strip())} if style == "checklist" else {"number": int(m[1])} if style == "ordered" else {})
            into({"type": "list", "style": style})["items"].append(item)
        elif (m := FIELD.match(line)) and m[1].lower() not in ("http", "https"):
            into({"type": "fields"})["items"].append({"label": m[1].strip(), "value": m[2]})
        else:
            into({"type": "paragraph"}, line)
    return blocks
