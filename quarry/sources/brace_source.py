"""Facts from Go, Rust and TypeScript/JavaScript texts.

There is no grammar here but a lexer, a tree of brackets, and the few shapes that the facts need: functions and their owners,
control flow, calls, imports, member uses. Expressions in between are token runs. Trees of bodies have a node for each control
structure, statement and call, with the labels that make two bodies alike in their language: Rust labels hold the names of callees, Go and
TypeScript labels only kinds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from quarry.sources.facts import Counts, Unparsed, qualify

_COMMON = r"""(?P<space>[ \t\r\f\v]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<number>\d[\w.]*)"""
_NAME = r"(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$]*)"
_MARKS = r"(?P<mark>=>|->|::|&&=|\|\|=|\?\?=|<<=|>>=|\.\.\.|\.\.=|\?\?|\?\.|&&|\|\||===|!==|==|!=|<=|>=|:=|<-|\+\+|--|[-+*/%&|^]=|\.\.|\S)"
_STRINGS = {
    "go": r'(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\')',
    "rust": r'(?P<string>b?r(#*)"[\s\S]*?"\2|b?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\[^\n]+?|[^\'\\\n])\')|(?P<lifetime>\'\w+)',
    "typescript": r'(?P<string>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\[\s\S]|[^`\\])*`)',
}
# a raw string's hashes are group 2 of the strings' pattern, counted from its own start
_LEXERS = {lang: re.compile("|".join((strings.replace(r"\2", "(?P=hashes)").replace("(#*)", "(?P<hashes>#*)"), _COMMON, _NAME, _MARKS))) for lang, strings in _STRINGS.items()}
_CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Group:
    """A bracket with what it holds."""

    text: str  # the opening bracket
    line: int
    items: list = field(default_factory=list)
    end: int = 0
    kind = "group"


Item = Token | Group


def parse(source: str, lang: str) -> list[Item]:
    """The text as a tree of brackets."""
    line, top = 1, Group("", 1)
    open_groups = [top]
    for m in _LEXERS[lang].finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "hashes":
            kind = "string"
        if kind == "line" or kind in ("space", "comment", "lifetime"):
            if kind == "line" and lang == "go" or "\n" in text and lang == "go":
                open_groups[-1].items.append(Token("newline", "\n", line))
        elif text in _CLOSING and kind == "mark":
            group = Group(text, line)
            open_groups[-1].items.append(group)
            open_groups.append(group)
        elif text in ")]}" and kind == "mark":
            if len(open_groups) == 1 or _CLOSING[open_groups[-1].text] != text:
                raise Unparsed(f"line {line}: {text}")
            open_groups.pop().end = line
        else:
            open_groups[-1].items.append(Token(kind, text, line))
        line += text.count("\n")
    if len(open_groups) > 1:
        raise Unparsed("an open bracket at the end")
    return top.items


def is_group(x: Item | None, bracket: str) -> bool:
    return isinstance(x, Group) and x.text == bracket


def texts(items: list[Item]) -> Iterator[Token]:
    for x in items:
        if isinstance(x, Group):
            yield Token("mark", x.text, x.line)
            yield from texts(x.items)
            yield Token("mark", _CLOSING[x.text], x.end)
        elif x.kind != "newline":
            yield x


@dataclass
class Function:
    name: str
    owner: str | None
    module: str
    params: Group
    body: Group
    line: int
    test: bool = False
    receiver: str | None = None
    kind: str = "inherent"  # of the owner: inherent or trait
    trait: str | None = None
    static: bool = False
    result: list[Item] = field(default_factory=list)

    @property
    def local(self) -> str:
        return qualify("", self.owner, self.name)


def split(items: list[Item], by: str = ",") -> list[list[Item]]:
    out: list[list[Item]] = [[]]
    for x in items:
        if isinstance(x, Token) and x.text == by:
            out.append([])
        elif not (isinstance(x, Token) and x.kind == "newline"):
            out[-1].append(x)
    return [p for p in out if p]


def _skip_generics(items: list[Item], i: int) -> int:
    """Behind ``<...>`` at i, if there is one."""
    if i < len(items) and isinstance(items[i], Token) and items[i].text == "<":
        depth = 0
        while i < len(items):
            t = items[i].text
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            i += 1
            if depth <= 0:
                break
    return i


def _text(items: list[Item], i: int) -> str:
    return items[i].text if 0 <= i < len(items) else ""


# functions by language


def go_functions(items: list[Item], module: str) -> Iterator[Function]:
    for i, x in enumerate(items):
        if x.text != "func" or i and _text(items, i - 1) not in ("\n", ";"):
            continue
        j, owner, receiver = i + 1, None, None
        if is_group(items[j] if j < len(items) else None, "("):
            names = [t.text for t in texts(items[j].items) if t.kind == "name"]
            receiver, owner = (names[0], names[1]) if len(names) > 1 else (None, names[0] if names else None)
            j += 1
        if j >= len(items) or items[j].kind != "name":
            continue
        name, j = items[j].text, j + 1
        if is_group(items[j] if j < len(items) else None, "["):
            j += 1
        if not is_group(items[j] if j < len(items) else None, "("):
            continue
        params, k = items[j], j + 1
        while k < len(items) and not is_group(items[k], "{") and items[k].kind != "newline":
            k += 2 if items[k].text in ("struct", "interface") else 1
        if is_group(items[k] if k < len(items) else None, "{"):
            test = owner is None and re.match(r"(?:Test|Benchmark|Example|Fuzz)(?:$|_|[A-Z])", name) is not None
            yield Function(name, owner, module, params, items[k], x.line, test, receiver, result=items[j + 1 : k])


def rust_functions(items: list[Item], module: str, owner: str | None = None, test: bool = False, kind: str = "inherent", trait: str | None = None) -> Iterator[Function]:
    i, marked = 0, False
    while i < len(items):
        x = items[i]
        if x.text == "#" and is_group(items[i + 1] if i + 1 < len(items) else None, "["):
            words = [t.text for t in texts(items[i + 1].items) if t.kind == "name"]
            head = [w for w in words[:3]]
            marked |= bool(words) and (words == ["cfg", "test"] or (words[-1] in ("test", "rstest") and words[0] != "cfg") or head[:1] == ["rstest"])
            i += 2
            continue
        if x.text == "mod" and is_group(items[i + 2] if i + 2 < len(items) else None, "{"):
            yield from rust_functions(items[i + 2].items, qualify(module, items[i + 1].text), None, test or marked)
            i, marked = i + 3, False
        elif x.text in ("impl", "trait") and x.kind == "name":
            j = _skip_generics(items, i + 1)
            k = j
            while k < len(items) and not is_group(items[k], "{") and items[k].text != ";":
                k += 1
            head = items[j:k]
            cut = next((n for n, t in enumerate(head) if t.text == "for"), None)
            named = head[cut + 1 :] if cut is not None else head
            own = [t.text for t in _before_generics(named) if t.kind == "name" and t.text not in ("dyn", "mut", "where")]
            of = [t.text for t in _before_generics(head[:cut]) if t.kind == "name"] if cut is not None else []
            if is_group(items[k] if k < len(items) else None, "{") and own:
                is_trait = x.text == "trait" or bool(of)
                yield from rust_functions(items[k].items, module, own[-1], test or marked, "trait" if is_trait else "inherent", own[-1] if x.text == "trait" else of[-1] if of else None)
            i, marked = k + 1, False
        elif x.text == "fn" and i + 1 < len(items) and items[i + 1].kind == "name":
            j = _skip_generics(items, i + 2)
            if not is_group(items[j] if j < len(items) else None, "("):
                i += 1
                continue
            k = j + 1
            while k < len(items) and not is_group(items[k], "{") and items[k].text != ";":
                k += 1
            if is_group(items[k] if k < len(items) else None, "{"):
                first = [t.text for t in texts(split(items[j].items)[0])] if split(items[j].items) else []
                has_self = "self" in first[:4]
                yield Function(items[i + 1].text, owner, module, items[j], items[k], x.line, test or marked, "self" if has_self else None, kind, trait, not has_self, items[j + 1 : k])
            i, marked = k + 1, False
        else:
            if isinstance(x, Group) and x.text == "{" or x.text == ";":
                marked = False
            i += 1


def _before_generics(items: list[Item]) -> list[Token]:
    out = []
    for x in items:
        if x.text in ("<", "where"):
            break
        out += [x] if isinstance(x, Token) else []
    return out


_NOT_NAMES = frozenset("if for while switch catch return function new typeof await throw else do in of case delete void yield with super import".split())


def ts_functions(items: list[Item], module: str, owner: str | None = None, test: bool = False, in_class: bool = False) -> Iterator[Function]:
    i = 0
    while i < len(items):
        x = items[i]
        if x.text in ("class", "namespace", "module") and x.kind == "name" and _text(items, i - 1) != ".":
            name = items[i + 1].text if i + 1 < len(items) and items[i + 1].kind == "name" and items[i + 1].text != "extends" else "anonymous"
            k = i + 1
            while k < len(items) and not is_group(items[k], "{") and items[k].text != ";":
                k += 1
            if is_group(items[k] if k < len(items) else None, "{"):
                if x.text == "class":
                    yield from ts_functions(items[k].items, module, name, test or name.startswith("Test"), True)
                else:
                    yield from ts_functions(items[k].items, qualify(module, name), None, test)
            i = k + 1
            continue
        if x.text == "function" and x.kind == "name":
            j = i + 1 + (_text(items, i + 1) == "*")
            name = items[j].text if j < len(items) and items[j].kind == "name" else "anonymous"
            j = _skip_generics(items, j + (name != "anonymous"))
            bound = _bound_name(items, i)
            if (found := _ts_body(items, j)) and (name != "anonymous" or bound):
                yield _ts(bound or name if name == "anonymous" else name, owner, module, items[j], items[found], x.line, test)
                i = found + 1
                continue
        elif in_class and x.kind == "name" and x.text not in _NOT_NAMES and (j := _skip_generics(items, i + 1)) < len(items) and is_group(items[j], "(") and (found := _ts_body(items, j)):
            f = _ts(x.text, owner, module, items[j], items[found], x.line, test)
            back = {_text(items, i - n) for n in (1, 2, 3)}
            f.static, f.receiver = "static" in back, None if "static" in back else "this"
            yield f
            i = found + 1
            continue
        elif is_group(x, "(") and (bound := _bound_name(items, i)):
            k = i + 1
            while k < len(items) and items[k].text not in ("=>", ";", ",", "=") and not is_group(items[k], "{"):
                k += 1
            if _text(items, k) == "=>" and is_group(items[k + 1] if k + 1 < len(items) else None, "{"):
                yield _ts(bound, owner, module, x, items[k + 1], x.line, test)
                i = k + 2
                continue
        i += 1


def _ts(name: str, owner: str | None, module: str, params: Group, body: Group, line: int, test: bool) -> Function:
    return Function(name, owner, module, params, body, line, test or name == "test" or (name.startswith("test_") and len(name) > 5), "this" if owner else None)


def _ts_body(items: list[Item], j: int) -> int | None:
    """The index of the body behind parameters at j."""
    if not is_group(items[j] if j < len(items) else None, "("):
        return None
    k = j + 1
    if _text(items, k) == ":":  # a result type; its own braces come right behind a colon or a bar
        k += 1
        while k < len(items) and items[k].text not in (";", "=", ",") and not (is_group(items[k], "{") and items[k - 1].text not in (":", "|", "&", "<", ",")):
            k += 1
    return k if is_group(items[k] if k < len(items) else None, "{") else None


def _bound_name(items: list[Item], i: int) -> str | None:
    """The simple name that a value at i is bound to, by ``name =`` or ``name: type =``."""
    k = i - 1
    while k >= 0 and _text(items, k) in ("async",):
        k -= 1
    if _text(items, k) != "=":
        return None
    k -= 1
    start = k
    while k >= 0 and start - k < 12 and _text(items, k) not in ("const", "let", "var", ";", "{", "}", "readonly", "public", "private"):
        k -= 1
    name = items[k + 1] if k >= -1 and k + 1 <= start else None
    return name.text if isinstance(name, Token) and name.kind == "name" else None


# complexity

_LOOPS = {"go": ("for",), "rust": ("for", "while", "loop"), "typescript": ("for", "while", "do")}
_KEYWORDS = {
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "rust": frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while".split()),
    "typescript": frozenset("as async await break case catch class const continue debugger default delete do else enum export extends finally for from function if import in instanceof interface let new of return static switch throw try typeof var void while with yield".split()),
}


def costs(f: Function, lang: str) -> Counts:
    c = Counts()
    for t in texts(f.body.items):
        if t.kind in ("number", "string") or t.kind == "name" and t.text not in _KEYWORDS[lang]:
            c.operand(t.text if lang == "rust" or t.kind != "string" else "<str>")
        elif t.text not in ")]};,":
            c.op(t.text)
    _flow(f.body.items, lang, c)
    return c


def _flow(items: list[Item], lang: str, c: Counts) -> None:
    """Branches of a token run. A control word's own brace nests; an ``else if`` counts inside the ``else`` in Rust and TypeScript, not in Go."""
    i = 0
    while i < len(items):
        x = items[i]
        word = x.text if isinstance(x, Token) and x.kind == "name" and _text(items, i - 1) not in (".", "?.") else ""
        if word == "if":
            i = _if(items, i, lang, c)
            continue
        if word in _LOOPS[lang]:
            if not (word == "for" and lang == "rust" and _text(items, i + 1) == "<"):
                c.branch()
                i = _nested(items, i + 1, lang, c)
                if word == "do" and _text(items, i) == "while":
                    i += 1
                continue
        elif word in ("match", "switch", "select"):
            i = _cases(items, i, lang, c)
            continue
        elif word == "catch" and lang == "typescript":
            c.branch()
            i = _nested(items, i + 1, lang, c)
            continue
        elif word in ("try", "finally") and lang == "typescript":
            i = _nested(items, i + 1, lang, c)
            continue
        elif isinstance(x, Token) and x.text in ("&&", "||", "??") and not (lang == "rust" and x.text == "||" and _closure(items, i)) and not (x.text == "??" and lang != "typescript"):
            c.branches += 1
            c.cognitive += 1
        elif isinstance(x, Token) and x.text == "?" and lang == "rust":
            c.branches += 1
        elif isinstance(x, Token) and x.text == "?" and lang == "typescript" and _text(items, i + 1) not in (":", ",", ")", "="):
            c.branch()
            with c:
                pass
        if isinstance(x, Group):
            _flow(x.items, lang, c)
        i += 1


def _closure(items: list[Item], i: int) -> bool:
    """``||`` begins a closure where no value stands before it."""
    return i == 0 or isinstance(items[i - 1], Token) and items[i - 1].kind == "mark" and items[i - 1].text != "?" or _text(items, i - 1) in ("move", "return")


def _nested(items: list[Item], i: int, lang: str, c: Counts) -> int:
    """Walk a head up to its body's brace, and the body one level deeper."""
    start = i
    while i < len(items) and not is_group(items[i], "{") and items[i].text != ";":
        i += 1
    if is_group(items[i] if i < len(items) else None, "{"):
        _flow(items[start:i], lang, c)
        with c:
            _flow(items[i].items, lang, c)
        return i + 1
    with c:  # a single statement
        _flow(items[start:i], lang, c)
    return i


def _if(items: list[Item], i: int, lang: str, c: Counts) -> int:
    c.branch()
    i = _nested(items, i + 1, lang, c)
    if _text(items, i) == ";" and _text(items, i + 1) == "else":
        i += 1
    if _text(items, i) == "else":
        if _text(items, i + 1) == "if":
            if lang == "go":
                return _if(items, i + 1, lang, c)
            with c:
                return _if(items, i + 1, lang, c)
        c.cognitive += 1
        return _nested(items, i + 1, lang, c)
    return i


def _cases(items: list[Item], i: int, lang: str, c: Counts) -> int:
    start = i + 1
    k = start
    while k < len(items) and not is_group(items[k], "{"):
        k += 1
    if k >= len(items):
        return start
    _flow(items[start:k], lang, c)
    body = items[k].items
    if lang == "rust":
        arms = sum(isinstance(x, Token) and x.text == "=>" for x in body)
        guards = [x for x in body if isinstance(x, Token) and x.text == "if"]
    else:
        arms, guards = sum(isinstance(x, Token) and x.text == "case" for x in body), []
    c.branch(max(0, arms - 1))
    with c:
        if guards:  # a guard is a part of its pattern, not a branch of its own
            body = [x for x in body if x not in guards]
        if lang == "go":
            with c:
                _flow(body, lang, c)
        else:
            _flow(body, lang, c)
    return k + 1


# trees


def body_tree(f: Function, lang: str) -> dict:
    labels, sizes = ["Block"], [1]

    def add(name: str, inside: Callable[[], None] | None = None) -> None:
        at = len(labels)
        labels.append(name)
        sizes.append(1)
        if inside:
            inside()
        sizes[at] = len(labels) - at

    def walk(items: list[Item]) -> None:
        for i, x in enumerate(items):
            after = items[i + 1] if i + 1 < len(items) else None
            if isinstance(x, Group):
                if x.text == "{":
                    add("Block", lambda: walk(x.items))
                elif not (i and items[i - 1].kind == "name" and items[i - 1].text not in _KEYWORDS[lang] and x.text == "("):
                    walk(x.items)
            elif x.kind == "name" and x.text in _KEYWORDS[lang]:
                if x.text not in ("mut", "pub", "ref", "as", "in", "of", "move", "from"):
                    add(x.text.capitalize())
            elif x.kind == "name" and is_group(after, "("):
                method = _text(items, i - 1) in (".", "?.")
                name = (f"MethodCall({x.text})" if method else f"CallPath({x.text})") if lang == "rust" else "Call"
                add(name, lambda: walk(after.items))
            elif x.kind == "name":
                add(f"Path({x.text})" if lang == "rust" else "Name")
            elif x.kind in ("string", "number"):
                add("Lit")
            elif x.kind == "mark" and x.text in ("&&", "||", "??", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "+", "-", "*", "/", "%", "=", ":=", "+=", "-="):
                add(f"Binary({x.text})" if lang == "rust" else "Assign" if x.text.endswith("=") and x.text[0] not in "=!<>" else "Binary")

    walk(f.body.items)
    sizes[0] = len(labels)
    return {"labels": labels, "sizes": sizes}


# calls, wrappers, members, imports

_PATH = {"go": ".", "rust": "::", "typescript": "."}


def call_sites(items: list[Item], lang: str) -> Iterator[tuple[list[str], bool, bool, int]]:
    """(path, after a value, on self, line) of each call in a token run."""
    for i, x in enumerate(items):
        if isinstance(x, Group):
            yield from call_sites(x.items, lang)
        elif x.kind == "name" and x.text not in _KEYWORDS[lang] and i + 1 < len(items):
            j = i + 1
            if lang == "rust" and _text(items, j) == "::" and _text(items, j + 1) == "<":
                j = _skip_generics(items, j + 1)
            elif lang == "typescript":
                j = _skip_generics(items, j) if _text(items, j) == "<" and is_group(items[_skip_generics(items, j)] if _skip_generics(items, j) < len(items) else None, "(") else j
            if not is_group(items[j] if j < len(items) else None, "(") or _text(items, i - 1) in ("func", "fn", "function"):
                continue
            path, k = [x.text], i - 1
            while k > 0 and _text(items, k) == _PATH[lang] and isinstance(items[k - 1], Token) and items[k - 1].kind == "name":
                path.insert(0, items[k - 1].text)
                k -= 2
            behind = _text(items, k) in (".", "?.", "::") and k >= 0
            if lang == "rust":
                dot = _text(items, i - 1) == "."
                on_self = dot and _text(items, i - 2) == "self" and _text(items, i - 3) != "."
                yield path, dot, on_self, x.line
            else:
                yield path, behind, not behind and path[0] == "this" and len(path) == 2, x.line


def calls(functions: list[Function], lang: str, module: str, seen: list[dict]) -> list[tuple]:
    out, spaces = [], {a["alias"] for a in seen}
    for f in functions:
        for path, behind, on_self, line in call_sites(f.body.items, lang):
            receiver = "self" if on_self else "expression" if behind else None
            if receiver is None and lang != "rust" and len(path) > 1 and path[0] not in spaces and not path[0][:1].isupper():
                receiver = "expression"
            if lang == "rust" and path[0] == "crate":
                path = [module.split("::")[0], *path[1:]]
            out.append((qualify(f.module, f.owner, f.name), f.module, f.owner, path[-1], path if receiver is None else None, receiver, seen, line))
    return out


#: Methods without arguments, with a literal, and with a closure, that only adapt a value.
_ADAPTERS = {
    "go": (),
    "rust": ("into", "try_into", "unwrap", "unwrap_or_default", "clone", "to_owned", "to_string", "as_ref", "as_mut", "as_str", "as_slice"),
    "typescript": ("toString", "valueOf", "toJSON", "toFixed", "toLocaleString", "asReadonly"),
}
_LITERAL_ADAPTERS = {"rust": ("expect",)}
_CLOSURE_ADAPTERS = {"rust": ("map_err",)}


def adapts(name: str, given: list[Item], lang: str) -> bool:
    """Whether a method call with these arguments only adapts its receiver."""
    if not given:
        return name in _ADAPTERS[lang]
    if name in _LITERAL_ADAPTERS.get(lang, ()):
        return len(given) == 1 and isinstance(given[0], Token) and (given[0].kind in ("string", "number") or given[0].text in ("true", "false"))
    return name in _CLOSURE_ADAPTERS.get(lang, ()) and (given[1:] if given[0].text == "move" else given)[0].text in ("|", "||")


def is_shim(f: Function, callee: str, lang: str) -> bool:
    """``new`` that calls its owner's ``default``, or the other way round: a convention, no wrapper."""
    other = {"new": "default", "default": "new"}.get(f.name)
    return lang == "rust" and f.owner is not None and other is not None and callee in (f"Self::{other}", f"{f.owner}::{other}")


def parameters(f: Function, lang: str) -> list[str] | None:
    """Names of the parameters, without the receiver; None where one is no plain name."""
    out = []
    for part in split(f.params.items):
        part = [x for x in part if x.text not in ("mut", "...", "public", "private", "readonly")]
        if lang == "rust" and any(isinstance(x, Token) and x.text == "self" for x in part[:3]):
            continue
        if not part or not isinstance(part[0], Token) or part[0].kind != "name" or lang == "typescript" and any(x.text == "=" for x in part):
            return [] if lang == "typescript" else None
        out.append(part[0].text)
    return out


def wrapper(f: Function, lang: str) -> tuple | None:
    """The finding for a body that is one forwarding call, behind adapters."""
    body = [x for x in f.body.items if x.kind != "newline" and x.text != ";"]
    if body and body[0].text == "return":
        body = body[1:]
    elif lang == "go" and [x.text for x in body[:2]] == ["_", "="]:
        body = body[2:]
    if lang == "typescript" and f.name == "constructor" or any(x.text in ("let", "if", "for", "match", "const", "var") for x in body):
        return None
    adapters: list[str] = []
    while len(body) > 2:
        if lang == "rust" and body[-1].text == "?" or lang == "typescript" and body[-1].text == "!":
            adapters.insert(0, body[-1].text)
            body = body[:-1]
        elif is_group(body[-1], "(") and _text(body, len(body) - 3) == "." and adapts(body[-2].text, body[-1].items, lang):
            adapters.insert(0, f".{body[-2].text}()")
            body = body[:-3]
        elif body[0].text == "await":
            adapters.append("await")
            body = body[1:]
        else:
            break
    if len(body) < 2 or not is_group(body[-1], "(") or body[-2].kind != "name" or not all(isinstance(x, Token) and (x.kind == "name" and (x.text not in _KEYWORDS[lang] or x.text == "crate") or x.text in (".", "::")) for x in body[:-1]):
        return None
    given = []
    for part in split(body[-1].items):
        names = [x for x in part if not (isinstance(x, Token) and x.text in ("&", "*", "mut", "..."))]
        if len(names) != 1 or names[0].kind != "name":
            return None
        given.append(names[0].text)
    wanted = parameters(f, lang)
    if wanted is None or sorted(given) != sorted(wanted) or is_shim(f, "".join(x.text for x in body[:-1]), lang):
        return None
    return f.local, f.line, f.body.end, "".join(x.text for x in body[:-1]), adapters, 1


def members(f: Function) -> tuple[set[str], set[str]]:
    """(fields, called methods) of the receiver."""
    fields, called = set(), set()

    def walk(items: list[Item]) -> None:
        for i, x in enumerate(items):
            if isinstance(x, Group):
                walk(x.items)
            elif x.text in (f.receiver, "Self") and _text(items, i - 1) != "." and _text(items, i + 1) in (".", "::", "?.") and i + 2 < len(items) and items[i + 2].kind == "name":
                (called if is_group(items[i + 3] if i + 3 < len(items) else None, "(") else fields).add(items[i + 2].text)

    walk(f.body.items)
    return fields, called


def methods(functions: list[Function], lang: str) -> list[tuple]:
    units: dict[tuple, list[Function]] = {}
    for f in functions:
        if f.owner and f.receiver and not f.static and not f.test and f.name != "constructor":
            units.setdefault((f.module, f.kind, f.trait, f.owner), []).append(f)
    out = []
    for (_, kind, trait, owner), own in units.items():
        names = {f.name for f in own}
        for i, f in enumerate(own):
            fields, called = members(f)
            if lang == "go":  # every member is a field; names are qualified, so calls meet no sibling by name
                out.append((kind, trait, owner, own[0].line, own[-1].body.end, i, f.local, f.line, f.body.end, sorted(fields | called), sorted(called & names)))
            else:
                out.append((kind, trait, owner, own[0].line, own[-1].body.end, i, f.name, f.line, f.body.end, sorted(fields), sorted(called & names)))
    return out


def rust_uses(items: list[Item]) -> Iterator[tuple[list[str], str, int]]:
    """(path, alias, line) of all ``use`` declarations; the alias of a glob is ``*``."""

    def tree(part: list[Item], before: list[str], line: int) -> Iterator[tuple[list[str], str, int]]:
        path, alias = list(before), None
        for i, x in enumerate(part):
            if is_group(x, "{"):
                for inner in split(x.items):
                    yield from tree(inner, path, line)
                return
            if x.text == "as":
                alias = _text(part, i + 1)
                break
            if x.kind == "name" or x.text == "*":
                path.append(x.text)
        if path and path[-1] == "self":
            path.pop()
        if path:
            yield path, alias or path[-1], line

    for i, x in enumerate(items):
        if x.text == "use" and x.kind == "name":
            end = next((k for k in range(i, len(items)) if items[k].text == ";"), len(items))
            yield from tree(items[i + 1 : end], [], x.line)
        elif isinstance(x, Group):
            yield from rust_uses(x.items)


def rust_mods(items: list[Item], parent: tuple[str, ...] = ()) -> Iterator[tuple[list[str], str, bool, int]]:
    """(inline modules around it, name, whether its items follow, line) of all module declarations outside functions."""
    for i, x in enumerate(items):
        if x.text == "mod" and x.kind == "name" and i + 2 < len(items) and items[i + 1].kind == "name":
            name, after = items[i + 1].text, items[i + 2]
            if is_group(after, "{"):
                yield list(parent), name, True, x.line
                yield from rust_mods(after.items, (*parent, name))
            elif after.text == ";":
                yield list(parent), name, False, x.line


def ts_imports(items: list[Item]) -> Iterator[tuple[str, list[tuple[str, str]], int]]:
    """(specifier, (exported, alias) pairs, line) of imports and re-exports."""
    for i, x in enumerate(items):
        if x.text in ("import", "export") and x.kind == "name":
            k = i + 1
            while k < len(items) and k - i < 12 and items[k].kind != "string" and items[k].text != ";":
                k += 1
            if k < len(items) and items[k].kind == "string" and (_text(items, k - 1) == "from" or k == i + 1):
                names = []
                for y in items[i + 1 : k]:
                    if is_group(y, "{"):
                        for part in split(y.items):
                            words = [t.text for t in part if t.kind == "name" and t.text not in ("as", "type")]
                            names += [(words[0], words[-1])] if words else []
                    elif y.kind == "name" and y.text not in ("from", "type", "as"):
                        names.append(("*" if _text(items, i + 1) == "*" else "default", y.text))
                yield items[k].text[1:-1], names, x.line


def go_imports(items: list[Item]) -> Iterator[tuple[str, str | None, int]]:
    """(path, alias, line)."""
    for i, x in enumerate(items):
        if x.text == "import" and i + 1 < len(items):
            run = items[i + 1].items if is_group(items[i + 1], "(") else items[i + 1 : i + 3]
            for k, y in enumerate(run):
                if isinstance(y, Token) and y.kind == "string":
                    before = run[k - 1] if k and isinstance(run[k - 1], Token) and run[k - 1].kind in ("name", "mark") else None
                    path = y.text[1:-1]
                    yield path, before.text if before else path.rsplit("/", 1)[-1], y.line


def _rows(kind: str, lang: str, items: list[Item], module: str, functions: list[Function], imports: list[tuple], seen: list[dict]) -> list[tuple]:
    if kind == "functions":
        return [(f.name, qualify(f.module, f.owner, f.name), f.module, f.owner, f.line, f.body.end, f.test, body_tree(f, lang), _signature(f, lang) if lang == "rust" else None) for f in functions]
    if kind == "units":
        return [(f.local, f.line, f.body.end, *costs(f, lang).row()) for f in functions]
    if kind == "methods":
        return methods(functions, lang)
    if kind == "wrappers":
        return [w for f in functions if not f.test and f.kind != "trait" and (w := wrapper(f, lang))]
    if kind == "calls":
        return calls(functions, lang, module, seen)
    if kind == "imports":
        return imports
    raise ValueError(kind)


def _signature(f: Function, lang: str) -> dict:
    words = lambda items: [t.text for t in texts(items) if t.kind == "name" and t.text not in _KEYWORDS[lang]]
    parts = [p for p in split(f.params.items) if not any(x.text == "self" for x in p[:3])]
    types = sorted({w for p in parts for w in words(p)[1:]})
    receiver = None if f.receiver is None else "ref" if any(x.text == "&" for x in f.params.items[:1]) else "value"
    tokens = [t for t in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", f.name).lower()) if t]
    return {
        "name_tokens": tokens, "parameter_count": len(parts), "parameter_names": [w[0] for p in parts if (w := words(p))], "parameter_type_paths": types, "return_type_paths": sorted(set(words(f.result))), "generics": [], "receiver": receiver,
    }


def go(kind: str, source: str, module: str) -> list[tuple]:
    items = parse("\n" + source, "go")
    _shift(items, -1)
    found = list(go_imports(items))
    seen = [{"alias": a, "target": p.rsplit("/", 1)[-1], "exported": None} for p, a, _ in found if a not in ("_", ".")]
    imports = [(module, 0, p.split("/"), [a or ""], "import", n) for p, a, n in found]
    return _rows(kind, "go", items, module, list(go_functions(items, module)), imports, seen)


def _shift(items: list[Item], by: int) -> None:
    for x in items:
        x.line += by
        if isinstance(x, Group):
            x.end += by
            _shift(x.items, by)


def rust(kind: str, source: str, module: str) -> list[tuple]:
    items = parse(source, "rust")
    if kind == "mods":
        return list(rust_mods(items))
    found = list(rust_uses(items))
    crate = module.split("::")[0]
    whole = lambda p: [crate, *p[1:]] if p[0] == "crate" else p
    seen = [{"alias": a, "target": "::".join(whole(p)), "exported": p[-1]} for p, a, _ in found]
    functions = list(rust_functions(items, module))
    imports = [(module, 0, p, [a], "use", n) for p, a, n in found]
    if kind == "imports":
        imports += rust_references(functions, {a: whole(p) for p, a, _ in found}, module)
    return _rows(kind, "rust", items, module, functions, imports, seen)


def rust_references(functions: list[Function], aliases: dict[str, list[str]], module: str) -> list[tuple]:
    """References to other modules besides imports: path calls, types of signatures, implemented traits; aliases are spelled out."""

    def spelled(path: list[str]) -> list[str] | None:
        return [*aliases[path[0]], *path[1:]] if path[0] in aliases else path if len(path) > 1 else None

    out = []
    for f in functions:
        out += [(module, 0, p, [path[-1]], "call", line) for path, behind, _, line in call_sites(f.body.items, "rust") if not behind and (p := spelled(path))]
        named = [t for part in split(f.params.items) for t in texts(part) if t.kind == "name"] + [t for t in texts(f.result) if t.kind == "name"]
        out += [(module, 0, aliases[t.text], [t.text], "type", t.line) for t in named if t.text in aliases]
        if f.kind == "trait" and f.trait in aliases:
            out.append((module, 0, aliases[f.trait], [f.trait], "impl_for", f.line))
    return out


def typescript(kind: str, source: str, module: str) -> list[tuple]:
    items = parse(source, "typescript")
    found = list(ts_imports(items))
    home = module.split("::")[:-1]
    seen = []
    for spec, names, _ in found:
        if spec.startswith("."):
            at = list(home)
            for part in spec.split("/"):
                at = at[:-1] if part == ".." else at if part == "." else [*at, re.sub(r"\.[cm]?[jt]sx?$", "", part)]
            seen += [{"alias": alias, "target": "::".join(at if exported == "*" else [*at, exported]), "exported": exported} for exported, alias in names]
    imports = [(module, 0, spec.split("/"), [e for e, _ in names] or ["*"], "import", n) for spec, names, n in found]
    return _rows(kind, "typescript", items, module, list(ts_functions(items, module)), imports, seen)
