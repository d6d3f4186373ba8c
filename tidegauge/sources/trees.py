"""Configuration trees: readers and writers of the text formats JSON (relaxed), INI, KTF headers, XPVP, YAML, XML and plist.

A tree is a dict in file order; a key that occurs again becomes a list; leaves are None, bool, int, float or str; keys that
begin with ``@`` are attributes. Everything here runs on the driver: such files are small.
"""

from __future__ import annotations

import copy
import json
import math
import plistlib
import re
import sys
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr


class Tree(dict):
    """A node; it remembers which keys occurred more than once."""

    def __init__(self, *a: object, **k: object) -> None:
        super().__init__(*a, **k)
        self.repeated: set[str] = set()



class TreeError(ValueError):
    """The text isn't a tree of the format."""


def scalar(text: str) -> object:
    """A word's value: integer, else float, else true/false/null, else the text itself."""
    t = text.strip()
    for kind in (lambda s: int(s, 0) if re.fullmatch(r"[+-]?(?:0[xX][0-9a-fA-F]+|\d+)", s) and not re.fullmatch(r"[+-]?0\d+", s) else None, lambda s: float(s) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", s) else None):
        if (v := kind(t)) is not None:
            return v
    words = {"true": True, "false": False, "null": None, "nan": math.nan, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
    return words[t] if t in words else t


def infer(text: str) -> object:
    """Value of a node's text: relaxed JSON if it looks like an array or object, a quoted string, else a word or the raw text."""
    t = text.strip()
    if t[:1] in "[{" and t:
        try:
            return parse_json(t)
        except TreeError:
            return t
    if len(t) >= 2 and t[0] == t[-1] == '"':
        try:
            return json.loads(t)
        except ValueError:
            return t[1:-1]
    return scalar(t) if t else None


def put(node: Tree, key: str, value: object) -> None:
    """Adds a child; a key there already turns into a list."""
    if key not in node:
        node[key] = value
    elif key in node.repeated:
        node[key].append(value)
    else:
        node[key] = [node[key], value]
        node.repeated.add(key)


# ---- relaxed JSON


class _Json:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> str:
        m = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S).match(self.text, self.at)
        self.at = m.end()
        return self.text[self.at : self.at + 1]

    def fail(self, what: str) -> TreeError:
        return TreeError(f"{what} at {self.at}")

    def value(self) -> object:
        c = self.space()
        if c == "{":
            return self.members()
        if c == "[":
            self.at += 1
            out = []
            while (c := self.space()) != "]":
                if not c:
                    raise self.fail("open array")
                if c == ",":
                    self.at += 1
                    continue
                out.append(self.value())
            self.at += 1
            return out
        if c in ('"', "'"):
            return self.string(c)
        m = re.compile(r"[^,:\[\]{}\n\"]+").match(self.text, self.at)
        if not m:
            raise self.fail("no value")
        self.at = m.end()
        return scalar(m[0])

    def string(self, quote: str) -> str:
        m = re.compile(rf"{quote}((?:[^{quote}\\]|\\.)*){quote}", re.S).match(self.text, self.at)
        if not m:
            raise self.fail("open string")
        self.at = m.end()
        plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda x: chr(int(x[1][1:], 16)) if len(x[1]) == 5 else plain.get(x[1], x[1]), m[1], flags=re.S)

    def members(self) -> Tree:
        self.at += 1
        out: Tree = Tree()
        while (c := self.space()) != "}":
            if not c:
                raise self.fail("open object")
            if c == ",":
                self.at += 1
                continue
            if c in ('"', "'"):
                key = self.string(c)
            else:
                m = re.compile(r"[^\s,:\[\]{}\"']+").match(self.text, self.at)
                if not m:
                    raise self.fail("no key")
                key, self.at = m[0], m.end()
            if self.space() != ":":
                raise self.fail("no colon")
            self.at += 1
            put(out, key, self.value())
        self.at += 1
        return out


def parse_json(text: str) -> object:
    """JSON with unquoted keys and words, values of several words, ``nan``, comments and stray commas allowed."""
    p = _Json(text)
    out = p.value()
    if p.space():
        raise p.fail("text after the value")
    return out


# ---- INI, KTF, XPVP


def parse_ini(text: str) -> Tree:
    """``[section]``, ``key = value``, dotted keys as paths, ``;`` comments; a section again becomes a list."""
    root: Tree = Tree()
    here = root
    for raw in re.split(r"\r\n|\r|\n", text):
        line = raw.strip()
        if not line or line[0] == ";":
            continue
        if m := re.fullmatch(r"\[\s*(.*?)\s*\](?:\s*;.*)?", line):
            here = Tree()
            put(root, m[1], here)
            continue
        key, sep, rest = line.partition("=")
        if not sep:
            continue
        value = re.match(r'(?:"(?:[^"\\]|\\.)*"|\\.|[^;"\\])*', rest.strip())[0].strip()
        set_path(here, key.strip().replace(".", "/"), infer(value))
    return root


_KTF = re.compile(r"""^(?P<depth>\s*)(?:(?P<item>-)\s*|(?P<more>:)\s?|(?P<key>(?:"[^"]*"|'[^']*'|\\.|[^\s:"'\\-]|(?<=\S)-)+)\s*:\s*)(?P<value>.*?)\s*$""")


def parse_ktf(text: str, comment: str | None = "#") -> Tree:
    """A tree of ``# key: value`` header lines: deeper indentation is a child, ``- value`` an array element, ``: text``
    continues the value before, values may be inline JSON. Other lines, such as table rows, are passed over.
    """
    root: Tree = Tree()
    stack: list[tuple[int, Tree]] = [(-1, root)]
    last: tuple[Tree, str] | None = None
    for raw in re.split(r"\r\n|\r|\n", text):
        line = raw
        if comment:
            if not line.startswith(comment):
                continue
            line = line.lstrip(comment)
        if not line.strip():
            continue
        m = _KTF.match(line)
        if not m:
            continue
        depth, value = len(m["depth"].expandtabs(8)), m["value"]
        if m["more"]:
            if last:
                old = last[0].get(last[1])
                last[0][last[1]] = value if old is None else f"{_newest(old)}\n{value}"
            continue
        if m["item"]:
            if last:
                old = last[0].get(last[1])
                last[0][last[1]] = [*(old if isinstance(old, list) else [] if old in (None, {}) else [old]), infer(value)]
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key = re.sub(r"\\(.)", r"\1", m["key"].strip("\"'"))
        parent = stack[-1][1]
        if value:
            put(parent, key, infer(value))
            last = (parent, key)
        else:
            child: Tree = Tree()
            put(parent, key, child)
            stack.append((depth, child))
            last = (parent, key) if parent.get(key) is child else None
    _prune(root)
    return root


def _newest(v: object) -> object:
    return v[-1] if isinstance(v, list) else v


def _prune(node: object) -> None:
    """Nodes without value and children are empty leaves."""
    if isinstance(node, dict):
        for k, v in node.items():
            if v == {}:
                node[k] = None
            _prune(v)
    elif isinstance(node, list):
        for v in node:
            _prune(v)


def parse_xpvp(text: str) -> Tree:
    """``path: value`` pairs, parted by ``;`` or line ends; a pair that begins with ``:`` continues the value before."""
    root: Tree = Tree()
    last = None
    for part in re.findall(r'(?:"(?:[^"\\]|\\.)*"|\\.|[^;\n\r"\\])+', text):
        part = part.strip()
        if not part:
            continue
        if part[0] == ":" and last:
            set_path(root, last, f"{get_path(root, last)}\n{part[1:].strip()}")
            continue
        path, sep, value = part.partition(":")
        if sep:
            last = path.strip()
            set_path(root, last, infer(re.sub(r"\\(.)", r"\1", value)))
    return root


# ---- paths


def _steps(path: str) -> list[tuple[str, int | None]]:
    out = []
    for part in path.replace("@", "/@").split("/"):
        if part and (m := re.fullmatch(r"(.*?)(?:\[(-?\d+)\])?", part)):
            out.append((m[1], None if m[2] is None else int(m[2])))
    return out


def get_path(tree: object, path: str, default: object = None) -> object:
    """Value at ``a/b[1]/c`` or ``a@attribute``; ``..`` goes up; ``default`` where there is nothing."""
    trail = [tree]
    for key, index in _steps(path):
        if key == "..":
            trail = trail[:-1] or trail
            continue
        node = trail[-1]
        if isinstance(node, list):
            node = node[0] if node else None
        node = node.get(key) if isinstance(node, dict) else None
        if index is not None:
            items = node if isinstance(node, list) else [node]
            node = items[index] if -len(items) <= index < len(items) else None
        if node is None:
            return default
        trail.append(node)
    return trail[-1]


def set_path(tree: Tree, path: str, value: object) -> None:
    """Sets the value at a path; missing nodes and list elements are made."""
    steps = _steps(path)
    for n, (key, index) in enumerate(steps):
        leaf = n == len(steps) - 1
        if index is None:
            if leaf:
                tree[key] = value
                return
            if not isinstance(tree.get(key), (dict, list)):
                tree[key] = Tree()
            tree = tree[key][-1] if isinstance(tree[key], list) else tree[key]
            continue
        items = tree.get(key)
        items = tree[key] = items if isinstance(items, list) else [] if items is None else [items]
        while len(items) <= index:
            items.append(None if leaf else Tree())
        if leaf:
            items[index] = value
            return
        tree = items[index]


def append(tree: Tree, path: str) -> Tree:
    """A new node at a path; what is there already becomes the first of a list."""
    *above, key = path.split("/")
    for k in above:
        if not isinstance(tree.get(k), (Tree, list)):
            tree[k] = Tree()
        tree = tree[k][-1] if isinstance(tree[k], list) else tree[k]
    node = Tree()
    put(tree, key, node)
    return node


def link(tree: Tree, key: str, node: object) -> None:
    """Makes a node that hangs elsewhere a child, too: both places show the same node from then on."""
    put(tree, key, node)


def unlink(tree: object, node: object) -> int:
    """Takes a node out of the children and lists below; gives how many places it had."""
    found = 0
    if isinstance(tree, dict):
        for k, v in list(tree.items()):
            if v is node:
                del tree[k]
                found += 1
            elif isinstance(v, list):
                found += unlink(v, node)
    elif isinstance(tree, list):
        kept = [v for v in tree if v is not node]
        found, tree[:] = len(tree) - len(kept), kept
    return found


def merge(tree: Tree, other: dict) -> Tree:
    """Adds copies of another tree's children; keys that occur in both become lists."""
    for k, v in other.items():
        put(tree, k, copy.deepcopy(v))
    return tree


def clear(tree: Tree) -> None:
    """Drops all children."""
    tree.clear()
    tree.repeated.clear()


def visit(tree: object, enter, leave=None, path: str = "") -> None:
    """Calls ``enter(path, node)`` for every node before its children, which False leaves out, and ``leave`` after them."""
    if enter(path, tree) is not False:
        if isinstance(tree, dict):
            for k, v in tree.items():
                visit(v, enter, leave, f"{path}{k}" if k.startswith("@") else f"{path}/{k}" if path else k)
        elif isinstance(tree, list):
            for i, v in enumerate(tree):
                visit(v, enter, leave, f"{path}[{i}]")
    if leave is not None:
        leave(path, tree)


def decode(node: dict, kind: type) -> object:
    """A dataclass instance from a node: fields by name, nested dataclasses decoded, missing ones left to their defaults."""
    import dataclasses
    import typing

    hints = typing.get_type_hints(kind)
    values = {}
    for f in dataclasses.fields(kind):
        if f.name not in node:
            continue
        v, hint = node[f.name], hints[f.name]
        item = typing.get_args(hint)[0] if typing.get_origin(hint) is list and typing.get_args(hint) else None
        if dataclasses.is_dataclass(hint) and isinstance(v, dict):
            v = decode(v, hint)
        elif item is not None:
            v = [decode(x, item) if dataclasses.is_dataclass(item) else x for x in (v if isinstance(v, list) else [v])]
        values[f.name] = v
    return kind(**values)


def walk(tree: object, path: str = ""):
    """``(path, leaf)`` of every leaf in order."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from walk(v, f"{path}{k}" if k.startswith("@") else f"{path}/{k}" if path else k)
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from walk(v, f"{path}[{i}]")
    else:
        yield path, tree


READERS = {".json": parse_json, ".ini": parse_ini, ".ktf": parse_ktf, ".xpvp": parse_xpvp}


def load_tree(path: str) -> Tree:
    """Tree of a file by its suffix; ``-.json`` and the like read standard input."""
    p = Path(path)
    reader = READERS.get(p.suffix.lower())
    if reader is None:
        raise TreeError(f"no tree format for {path}")
    return reader(text_of(path))


def text_of(path: str) -> str:
    """Text of a file, or of standard input for ``-`` with any suffix."""
    p = Path(path)
    return sys.stdin.read() if p.stem == "-" else p.read_text()


# ---- writers


def _plain(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("Infinity" if v > 0 else "-Infinity") if math.isinf(v) else repr(v)
    return str(v)


def to_json(tree: object, indent: int | None = 2, strict: bool = True) -> str:
    """JSON; ``strict`` writes NaN and infinities as null, else as the usual literals."""

    def clean(v: object) -> object:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        return None if strict and isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(clean(tree), indent=indent, ensure_ascii=False)


def to_ktf(tree: Tree, comment: str = "# ") -> str:
    out: list[str] = []

    def add(key: str, v: object, depth: int) -> None:
        pad = comment + "  " * depth
        if isinstance(v, dict):
            out.append(f"{pad}{key}:")
            for k, x in v.items():
                add(k, x, depth + 1)
        elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
            for x in v:
                add(key, x, depth)
        elif isinstance(v, list):
            out.append(f"{pad}{key}: {to_json(v, None)}")
        else:
            first, *rest = _plain(v).split("\n")
            out.append(f"{pad}{key}: {first}".rstrip())
            out.extend(f"{pad}  : {r}" for r in rest)

    for k, v in tree.items():
        add(k, v, 0)
    return "\n".join(out) + "\n"


def to_yaml(tree: object) -> str:
    out: list[str] = []

    def word(v: object) -> str:
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False) if not re.fullmatch(r"[A-Za-z_][\w ./-]*", v) or v in ("true", "false", "null", "yes", "no") else v
        return "null" if v is None else ".nan" if isinstance(v, float) and math.isnan(v) else _plain(v)

    def add(v: object, depth: int) -> None:
        pad = "  " * depth
        if isinstance(v, dict):
            for k, x in v.items():
                key = json.dumps(k) if not re.fullmatch(r"[A-Za-z_][\w-]*", k) else k
                if isinstance(x, (dict, list)) and x:
                    out.append(f"{pad}{key}:")
                    add(x, depth + 1)
                else:
                    out.append(f"{pad}{key}: {'{}' if x == {} else '[]' if x == [] else word(x)}")
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, (dict, list)) and x:
                    out.append(f"{pad}-")
                    add(x, depth + 1)
                else:
                    out.append(f"{pad}- {'{}' if x == {} else '[]' if x == [] else word(x)}")
        else:
            out.append(pad + word(v))

    add(tree, 0)
    return "\n".join(out) + "\n"


def _tag(name: str) -> str:
    t = re.sub(r"[^A-Za-z0-9_.-]", "_", name)
    return t if re.match(r"[A-Za-z_]", t) else f"_{t}"


def to_xml(tree: Tree, root: str = "tree") -> str:
    """XML; ``@key`` becomes an attribute, other characters of names become ``_``."""

    def node(name: str, v: object, depth: int) -> str:
        pad = "  " * depth
        if isinstance(v, list):
            return "".join(node(name, x, depth) for x in v)
        attributes, children = "", []
        if isinstance(v, dict):
            attributes = "".join(f" {_tag(k[1:])}={quoteattr(_plain(x))}" for k, x in v.items() if k.startswith("@"))
            children = [(k, x) for k, x in v.items() if not k.startswith("@")]
            inner = "".join(node(k, x, depth + 1) for k, x in children)
            return f"{pad}<{_tag(name)}{attributes}>\n{inner}{pad}</{_tag(name)}>\n" if inner else f"{pad}<{_tag(name)}{attributes}/>\n"
        return f"{pad}<{_tag(name)}>{escape(_plain(v))}</{_tag(name)}>\n"

    return '<?xml version="1.0" encoding="UTF-8"?>\n' + node(root, tree, 0)


def to_plist(tree: object) -> str:
    def clean(v: object) -> object:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        return "" if v is None else v

    return plistlib.dumps(clean(tree), sort_keys=False).decode()


def _escaped(v: object) -> str:
    return re.sub(r'([\;"])', r"\\\1", _plain(v)).replace("\n", "\\n")


def to_ini(tree: Tree) -> str:
    return "".join(f"{path.replace('/', '.')} = {_escaped(v)};\n" for path, v in walk(tree))


def to_xpvp(tree: Tree) -> str:
    return "".join(f"{path}: {_escaped(v)}\n" for path, v in walk(tree))


def to_c(text: str, name: str = "text") -> str:
    """A C string of the text, line by line, to be compiled into a program."""
    rows = [json.dumps(line + "\n", ensure_ascii=False) for line in text.splitlines()]
    return f"static const char {name}[] =\n" + "\n".join(f"    {r}" for r in rows or ['""']) + ";\n"


WRITERS = {".json": to_json, ".ktf": to_ktf, ".yaml": to_yaml, ".yml": to_yaml, ".xml": to_xml, ".plist": to_plist, ".ini": to_ini, ".xpvp": to_xpvp}


def save_tree(tree: Tree, path: str) -> None:
    writer = WRITERS.get(Path(path).suffix.lower())
    if writer is None:
        raise TreeError(f"no tree format for {path}")
    Path(path).write_text(writer(tree))
