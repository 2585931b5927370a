"""CSS selectors over the document tree: type, class, id, attributes, the structural
pseudo-classes that name a place, and the four combinators."""

from __future__ import annotations

import re
from functools import lru_cache

from weftlake.functions.dom import Element

PART = re.compile(r"\s*([>+~])\s*|(\s+)|([#.])((?:\\.|[\w-]|[^\x00-\x7f])+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*(?:[iIsS]\s*)?\]|:([\w-]+)(?:\(([^()]*)\))?|(\*|(?:[\w-]|[^\x00-\x7f])+)")


class BadSelector(ValueError):
    pass


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """Steps from the right: (combinator to the next step's element, tests)."""
    steps: list[tuple[str, list]] = [("", [])]
    text, pos = selector.strip(), 0
    while pos < len(text):
        m = PART.match(text, pos)
        if not m or m.end() == pos:
            raise BadSelector(selector)
        pos = m.end()
        if m[1] or m[2]:
            if not steps[-1][1]:
                raise BadSelector(selector)
            steps.append((m[1] or " ", []))
        elif m[3]:
            steps[-1][1].append(("id" if m[3] == "#" else "class", re.sub(r"\\(.)", r"\1", m[4])))
        elif m[5]:
            steps[-1][1].append(("attr", m[5].lower(), m[6], m[7] if m[7] is not None else m[8] if m[8] is not None else m[9]))
        elif m[10]:
            steps[-1][1].append(("place", m[10].lower(), m[11]))
        else:
            steps[-1][1].append(("tag", m[12].lower()))
    if not steps[-1][1]:
        raise BadSelector(selector)
    return tuple((c, tuple(t)) for c, t in steps)


def _nth(formula: str, n: int) -> bool:
    f = formula.replace(" ", "").lower()
    f = {"odd": "2n+1", "even": "2n"}.get(f, f)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", f)
    if not m or not f:
        raise BadSelector(formula)
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _siblings(e: Element) -> list[Element]:
    return [k for k in e.up.kids if isinstance(k, Element)] if e.up else [e]


def _passes(e: Element, test: tuple) -> bool:
    kind = test[0]
    if kind == "tag":
        return test[1] in ("*", e.tag)
    if kind == "id":
        return e.attrs.get("id") == test[1]
    if kind == "class":
        return test[1] in e.classes()
    if kind == "attr":
        v, op, want = e.attrs.get(test[1]), test[2], test[3]
        if v is None:
            return False
        if op is None or op == "=":
            return op is None or v == want
        if op == "~=":
            return want in v.split()
        if op == "|=":
            return v == want or v.startswith(want + "-")
        return bool(want) and {"^=": v.startswith(want), "$=": v.endswith(want), "*=": want in v}[op]
    _, name, arg = test
    all_kids = _siblings(e)
    same = [k for k in all_kids if k.tag == e.tag]
    place = {"first-child": (all_kids, 1), "last-child": (all_kids, -1), "first-of-type": (same, 1), "last-of-type": (same, -1)}
    if name in place:
        pool, want = place[name]
        return pool[0 if want == 1 else -1] is e
    if name == "only-child":
        return len(all_kids) == 1
    if name == "root":
        return e.tag == "html"
    if name == "empty":
        return not e.kids
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
        pool = same if "type" in name else all_kids
        if "last" in name:
            pool = pool[::-1]
        return _nth(arg or "", next(i for i, k in enumerate(pool, 1) if k is e))
    if name == "not":
        return not matches(e, arg or "")
    raise BadSelector(name)


def _from(e: Element, steps: tuple, at: int) -> bool:
    if not all(_passes(e, t) for t in steps[at][1]):
        return False
    if at == 0:
        return True
    how = steps[at][0]
    if how == ">":
        return e.up is not None and e.up.tag != "#document" and _from(e.up, steps, at - 1)
    if how == " ":
        up = e.up
        while up is not None and up.tag != "#document":
            if _from(up, steps, at - 1):
                return True
            up = up.up
        return False
    before = []
    for k in _siblings(e):
        if k is e:
            break
        before.append(k)
    return any(_from(k, steps, at - 1) for k in (before[-1:] if how == "+" else before))


def matches(e: Element, selector: str) -> bool:
    steps = compiled(selector)
    return _from(e, steps, len(steps) - 1)


def select(root: Element, selector: str):
    """Matching elements below ``root`` in document order."""
    steps = compiled(selector)
    return (e for e in root.elements() if _from(e, steps, len(steps) - 1))


def select_one(root: Element, selector: str) -> Element | None:
    return next(select(root, selector), None)


def split_groups(selector: str) -> list[str]:
    """The parts of a selector list, cut at commas outside of brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(selector[start:i])
            start = i + 1
    return [s.strip() for s in [*out, selector[start:]]]
