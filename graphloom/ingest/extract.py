"""Symbols, imports, calls and routes of one source file."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from graphloom.ingest.declarations import Function, functions
from graphloom.ingest.lexing import decode, language_of, lex

HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


class Symbol(NamedTuple):
    id: str
    type: str
    name: str
    qualified_name: str
    line_start: int | None
    line_end: int | None
    signature: str | None
    docstring: str | None
    tags: list[str]


class Link(NamedTuple):
    source: str
    kind: str  # call, import, inherits, route
    name: str  # what the source writes
    qualifier: str | None  # what stands before the name: self, an alias, a type
    module: str | None  # the module or path an imported name comes from
    line: int
    receiver: str | None = None  # the type of the qualifier, where the source tells
    via: str | None = None  # how it tells: param, local, module, self_attr, ctor, receiver


def package_of(path: str, text: str | None, lang: str | None) -> str | None:
    """What files share whose names need no import: a Java package, a C# namespace, a Go folder."""
    if lang == "go":
        return path.rsplit("/", 1)[0].replace("/", ".") if "/" in path else ""
    m = re.search({"java": r"^\s*package\s+([\w.]+)\s*;", "csharp": r"^\s*namespace\s+([\w.]+)"}.get(lang or "", r"(?!)"), text or "", re.M)
    return m[1] if m else None


def module_of(path: str) -> str:
    """Dotted name of a file without its extension; a package's initialiser stands for the package."""
    return re.sub(r"\.__init__$", "", re.sub(r"\.\w+$", "", path).replace("/", "."))


def extract(path: str, content: bytes | None) -> tuple[list[Symbol], list[Link]]:
    """What a file declares and what it refers to; of an unreadable file only its own node."""
    lang, text = language_of(path), decode(content)
    lines = 0 if not text else len(text.splitlines())
    own = Symbol(path, "file", path.rsplit("/", 1)[-1], module_of(path), 1 if lines else None, lines or None, None, None, [])
    if lang is None or not text:
        return [own], []
    if lang == "python":
        symbols, links = _python(path, text)
    else:
        symbols, links = _braced(path, text.replace("\r\n", "\n").replace("\r", "\n"), lang)
    links += injected(path, text, lang) + components(path, text, lang, symbols)
    links += [Link(path, "route", f"{v} {p}", h, None, n) for v, p, h, n in routes(path, text, lang)]
    return [own, *symbols], links


# Python

#: Base classes that make a class a model, a configuration or a schema.
_BASES = {"BaseModel": "model", "NamedTuple": "model", "BaseSettings": "config", "TypedDict": "schema", "Enum": "schema", "IntEnum": "schema", "StrEnum": "schema"}


def _class_tags(path: str, name: str, bases: list[str]) -> list[str]:
    tags = {_BASES[b] for b in bases if b in _BASES}
    folders = path.lower().split("/")[:-1]
    for words, tag in ((("models", "model"), "model"), (("schemas", "schema"), "schema"), (("stores", "store", "repositories", "repository"), "store"), (("config", "settings"), "config")):
        if any(f in words for f in folders) or any(w in name.lower() for w in words[-1:]):
            tags.add(tag)
    return sorted(tags)


def _python(path: str, text: str) -> tuple[list[Symbol], list[Link]]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _loose_python(path, text)
    mod = module_of(path)
    symbols: list[Symbol] = []
    links: list[Link] = []
    imported: dict[str, tuple[str, str | None]] = {}  # local name: module, name in it

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else None
        return None

    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                imported[a.asname or a.name.split(".")[0]] = (a.name, None)
                links.append(Link(path, "import", a.name, None, a.name, node.lineno))
        elif isinstance(node, ast.ImportFrom):
            base = ".".join(mod.split(".")[: -node.level]) if node.level else ""
            source = ".".join(x for x in (base, node.module or "") if x)
            for a in node.names:
                imported[a.asname or a.name] = (source, a.name)
                links.append(Link(path, "import", a.name, None, source, node.lineno))

    def made(value: ast.AST | None) -> str | None:
        """The class that a value is an instance of: the name before the parentheses."""
        return value.func.id if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id[:1].isupper() else None

    def hinted(annotation: ast.AST | None) -> str | None:
        if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
            return annotation.value if annotation.value.isidentifier() else None
        if isinstance(annotation, ast.BinOp):  # X | None
            return hinted(annotation.left)
        if isinstance(annotation, ast.Subscript) and isinstance(annotation.value, ast.Name) and annotation.value.id == "Optional":
            return hinted(annotation.slice)
        return annotation.id if isinstance(annotation, ast.Name) and annotation.id[:1].isupper() else None

    def assigned(body: ast.AST) -> Iterator[tuple[ast.AST, str]]:
        for n in ast.walk(body):
            if isinstance(n, ast.Assign) and (t := made(n.value)):
                yield from ((x, t) for x in n.targets)
            elif isinstance(n, ast.AnnAssign) and (t := hinted(n.annotation) or made(n.value)):
                yield n.target, t

    of_module = {x.id: t for n in tree.body if isinstance(n, (ast.Assign, ast.AnnAssign)) for x, t in assigned(n) if isinstance(x, ast.Name)}
    of_self: dict[str, str] = {}
    of_param: dict[str, str] = {}
    of_local: dict[str, str] = {}

    def typed(base: str) -> tuple[str, str] | None:
        """The class of what stands before a method, and how the source tells."""
        if base.startswith("self.") and base[5:] in of_self:
            return of_self[base[5:]], "self_attr"
        for known, how in ((of_param, "param"), (of_local, "local"), (of_module, "module")):
            if base in known:
                return known[base], how
        return None

    def refer(node: ast.Call, source: str) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            module, name = imported.get(f.id, (None, f.id))
            links.append(Link(source, "call", name or f.id, None, module, node.lineno))
        elif isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name):
                c = f.value.func.id
                links.append(Link(source, "call", f.attr, c, imported.get(c, (None,))[0], node.lineno, imported.get(c, (None, c))[1] or c, "ctor"))
                return
            base = dotted(f.value)
            if base is None:
                return
            if (t := typed(base)) is not None:
                links.append(Link(source, "call", f.attr, base, imported.get(t[0], (None,))[0], node.lineno, imported.get(t[0], (None, t[0]))[1] or t[0], t[1]))
                return
            head = base.split(".")[0]
            module = ".".join([*(x for x in imported[head] if x), *base.split(".")[1:]]) if head in imported else None
            links.append(Link(source, "call", f.attr, base, module, node.lineno))

    def visit(node: ast.AST, owner: str, class_name: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) and owner in (path, f"{path}::{class_name}"):
                q = f"{class_name}.{child.name}" if class_name else child.name
                test = child.name.startswith("test_") and (class_name is None or class_name.startswith("Test"))
                tags = sorted({d.split(".")[-1] for d in map(dotted, [x.func if isinstance(x, ast.Call) else x for x in child.decorator_list]) if d})
                head = ("async def " if isinstance(child, ast.AsyncFunctionDef) else "def ") + f"{child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                symbols.append(Symbol(f"{path}::{q}", "test" if test else "method" if class_name else "function", child.name, f"{mod}.{q}", child.lineno, child.end_lineno, head, ast.get_docstring(child), tags))
                of_param.clear()
                of_local.clear()
                a = child.args
                of_param.update({x.arg: t for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if (t := hinted(x.annotation))})
                of_local.update({x.id: t for x, t in assigned(child) if isinstance(x, ast.Name)})
                for c in ast.walk(child):
                    if isinstance(c, ast.Call):
                        refer(c, f"{path}::{q}")
                of_param.clear()
                of_local.clear()
            elif isinstance(child, ast.ClassDef) and owner == path:
                of_self.clear()
                of_self.update({x.attr: t for x, t in assigned(child) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"})
                for fn in child.body:  # self.x = x with a typed parameter
                    if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        hints = {x.arg: t for x in fn.args.args if (t := hinted(x.annotation))}
                        of_self.update({x.attr: hints[n.value.id] for n in ast.walk(fn) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Name) and n.value.id in hints for x in n.targets if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"})
                bases = [b for b in map(dotted, child.bases) if b]
                symbols.append(Symbol(f"{path}::{child.name}", "class", child.name, f"{mod}.{child.name}", child.lineno, child.end_lineno, f"class {child.name}", ast.get_docstring(child), _class_tags(path, child.name, bases)))
                links.extend(Link(f"{path}::{child.name}", "inherits", b.split(".")[-1], None, imported.get(b.split(".")[0], (None,))[0], child.lineno) for b in bases)
                visit(child, f"{path}::{child.name}", child.name)
            elif isinstance(child, ast.Call) and owner == path:
                refer(child, path)
            elif isinstance(child, (ast.Assign, ast.AnnAssign, ast.Expr)):
                for c in ast.walk(child):
                    if isinstance(c, ast.Call):
                        refer(c, owner)

    visit(tree, path, None)
    return symbols, links


def _loose_python(path: str, text: str) -> tuple[list[Symbol], list[Link]]:
    """Declarations of a file that does not parse; no references."""
    mod = module_of(path)
    return [Symbol(f"{path}::{f.name}", "method" if "." in f.name else "function", f.name.rsplit(".", 1)[-1], f"{mod}.{f.name}", f.line, None, None, f.doc, []) for f in _once(functions(text, "python"))], []


def _once(found: Iterator[Function]) -> Iterator[Function]:
    seen: set[str] = set()
    for f in found:
        if f.name not in seen:
            seen.add(f.name)
            yield f


# Languages with braces

_CLASS = {
    "java": r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?(?:\([^)]*\))?((?:\s+(?:extends|implements|permits)\s+[\w<>,. ?]+)*)\s*\{",
    "csharp": r"\b(class|interface|struct|enum|record)\s+(\w+)(?:<[^{>]*>)?(?:\([^)]*\))?(\s*:\s*[\w<>,. ?]+)?[^{;]*[{;]",
    "go": r"\btype\s+(\w+)\s+(struct|interface)\s*\{",
}
_CLASS["javascript"] = _CLASS["typescript"] = r"\b(class|interface|enum)\s+(\w+)(?:<[^{]*?>)?((?:\s+(?:extends|implements)\s+[\w<>,. $]+)*)\s*\{"
_IMPORT = {
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)\s*;", "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "go": r"^\s*(?:import\s+)?(?:(\w+|\.|_)\s+)?\"([\w./-]+)\"\s*$",
    "javascript": r"^\s*(?:import|export)\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([\w$]+))?\s*(?:from\s*)?['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)",
}
_IMPORT["typescript"] = _IMPORT["javascript"]
_CALL_WORDS = frozenset("if for while switch catch return new throw else do try function func using lock foreach await typeof sizeof nameof super this class def case synchronized assert".split())
_GO_WORDS = frozenset("range map make len cap append panic select go defer".split())


def _blank(text: str, tokens: list) -> str:
    """The text with comments and strings made blank, at the same places."""
    out, at = [], 0
    for k, a, z in tokens:
        if k in ("c", "s", "r"):
            out += [text[at:a], re.sub(r"[^\n]", " ", text[a:z])]
            at = z
    return "".join(out) + text[at:]


def _braced(path: str, text: str, lang: str) -> tuple[list[Symbol], list[Link]]:
    tokens, _ = lex(text, lang)
    bare = _blank(text, tokens)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda p: bisect_right(starts, p)
    mod = module_of(path)
    symbols: list[Symbol] = []
    links: list[Link] = []
    bases: list[tuple[str, str, int]] = []
    for m in re.finditer(_CLASS[lang], bare):
        kind, name = (m[2], m[1]) if lang == "go" else (m[1], m[2])
        tags = [kind] if kind not in ("class",) else []
        symbols.append(Symbol(f"{path}::{name}", "class", name, f"{mod}.{name}", line(m.start()), None, m[0].rstrip(" {;").strip(), None, sorted(set(tags + _class_tags(path, name, [])))))
        if lang != "go" and m[3]:
            for base in re.findall(r"[A-Za-z_$][\w$.]*", re.sub(r"<[^<>]*>|\b(?:extends|implements|permits)\b|:", " ", m[3])):
                bases.append((f"{path}::{name}", base.split(".")[-1], line(m.start())))
    imported = _imports(path, text, lang, links, line)
    links.extend(Link(i, "inherits", base, None, imported.get(base), n) for i, base, n in bases)
    spans = []
    for f in _once(functions(text, lang)):
        short = f.name.rsplit(".", 1)[-1]
        test = lang == "go" and short.startswith("Test") or lang in ("javascript", "typescript") and short in ("it", "test")
        last = line(max(f.start, f.end - 1))
        symbols.append(Symbol(f"{path}::{f.name}", "test" if test else "method" if "." in f.name else "function", short, f"{mod}.{f.name}", f.line, last, text[f.start : f.end].split("{", 1)[0].split("=>", 1)[0].strip(), f.doc, []))
        spans.append((f.start, f.end, f"{path}::{f.name}", short))
    receivers = {f"{path}::{m[2]}.{m[3]}": (m[1], m[2]) for m in re.finditer(r"\bfunc\s*\(\s*(\w+)\s+\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)", bare)} if lang == "go" else {}
    for m in re.finditer(r"(?:([\w$]+(?:\s*\??\.\s*[\w$]+)*)\s*\??\.\s*)?([A-Za-z_$][\w$]*)\s*(?:<[\w<>, .]*>)?\(", bare):
        name = m[2]
        owner = next((s for s in spans if s[0] <= m.start() < s[1]), None)
        if name in _CALL_WORDS or lang == "go" and name in _GO_WORDS or owner and name == owner[3] and m[1] is None and bare[owner[0] : m.start(2)].count("(") == 0:
            continue
        qualifier = re.sub(r"\s", "", m[1]) if m[1] else None
        head = (qualifier or name).split(".")[0]
        recv = receivers.get(owner[2]) if owner and lang == "go" else None
        if recv and qualifier == recv[0]:
            links.append(Link(owner[2], "call", name, qualifier, None, line(m.start(2)), recv[1], "receiver"))
        else:
            links.append(Link(owner[2] if owner else path, "call", name, qualifier, imported.get(head), line(m.start(2))))
    return symbols, links


def _imports(path: str, text: str, lang: str, links: list[Link], line) -> dict[str, str]:
    names: dict[str, str] = {}
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    block = text
    if lang == "go":
        block = re.sub(r"(?s)\A(.*?\bimport\b(?:\s*\(.*?\)|[^\n]*)).*", r"\1", text)
    for m in re.finditer(_IMPORT[lang], block, re.M):
        n = line(m.start())
        if lang == "java":
            names[m[2]] = f"{m[1]}.{m[2]}"
            links.append(Link(path, "import", m[2], None, f"{m[1]}.{m[2]}", n))
        elif lang == "csharp":
            links.append(Link(path, "import", m[1].split(".")[-1], None, m[1], n))
        elif lang == "go":
            local = m[1] if m[1] and m[1] not in (".", "_") else m[2].rsplit("/", 1)[-1]
            names[local] = m[2]
            links.append(Link(path, "import", local, None, m[2], n))
        else:
            source = m[4] or m[7]
            if source.startswith("."):
                parts = folder.split("/") if folder else []
                for p in source.split("/"):
                    parts = parts[:-1] if p == ".." else parts if p in (".", "") else [*parts, p]
                source = "/".join(parts)
            many = (m[2] or "") + "," + (m[6] or "")
            found = [x for x in (m[1], m[3], m[5]) if x] + [re.sub(r".*\bas\s+|.*:\s*", "", x.strip()) for x in many.split(",") if x.strip()]
            for x in found or [source.rsplit("/", 1)[-1]]:
                names[x] = source
                links.append(Link(path, "import", x, None, source, n))
    return names


# Routes of frameworks


def routes(path: str, text: str, lang: str) -> Iterator[tuple[str, str, str | None, int]]:
    """Verb, path, handler and line of each route: FastAPI, Flask, Express, Next, Nest, Spring, Gin, Hertz, ASP.NET."""
    at = lambda p: text.count("\n", 0, p) + 1
    join = lambda a, b: "/" + "/".join(x.strip("/") for x in (a, b) if x and x.strip("/"))
    if lang == "python":
        for m in re.finditer(r"^[ \t]*@(\w+)\.(\w+)\(\s*[rf]?[\"']([^\"']*)[\"']([^\n]*)\)\s*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async )?def (\w+)", text, re.M):
            if m[2] in HTTP_VERBS:
                yield m[2].upper(), m[3], m[5], at(m.start())
            elif m[2] == "route":
                for v in re.findall(r"[\"'](\w+)[\"']", (re.search(r"methods\s*=\s*\[([^\]]*)\]", m[4]) or ["", ""])[1]) or ["GET"]:
                    yield v.upper(), m[3], m[5], at(m.start())
    elif lang in ("javascript", "typescript"):
        prefix = {m[2]: m[1] for m in re.finditer(r"\.use\(\s*['\"]([^'\"]+)['\"]\s*,\s*([\w$]+)\s*\)", text)}
        for m in re.finditer(r"\b([\w$]+)\.(get|post|put|patch|delete)\(\s*['\"`](/[^'\"`]*)['\"`]\s*,(?:[^()]*,)?\s*([\w$.]+)?", text):
            yield m[2].upper(), join(prefix.get(m[1], ""), m[3]), m[4], at(m.start())
        base = re.search(r"@Controller\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", text)
        if base:
            for m in re.finditer(r"@(Get|Post|Put|Patch|Delete)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?(\w+)", text):
                yield m[1].upper(), join(base[1] or "", m[2] or ""), m[3], at(m.start())
        page = re.search(r"(?:^|/)(?:src/)?(?:pages/(api/.*)|app/(api/.*)/route)\.[jt]sx?$", path)
        if page:
            url = re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", re.sub(r"/index$", "", page[1] or page[2]))
            if page[1]:
                yield "ALL", "/" + url, None, 1
            for m in re.finditer(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE)\b", text) if page[2] else ():
                yield m[1], "/" + url, m[1], at(m.start())
    elif lang == "java":
        if re.search(r"@(Rest)?Controller\b", text):
            head = text[: (re.search(r"\bclass\s+\w+", text) or re.search(r"\Z", text)).start()]
            b = re.search(r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", head)
            for m in re.finditer(r"@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:\"([^\"]*)\")?[^)]*\))?[^;{]*?\b(\w+)\s*\(", text):
                yield m[1].upper(), join(b[1] if b else "", m[2] or ""), m[3], at(m.start())
    elif lang == "go":
        groups = {m[1]: (m[2], m[3]) for m in re.finditer(r"(\w+)\s*:?=\s*(\w+)\.Group\(\s*\"([^\"]*)\"", text)}

        def full(var: str, p: str, depth: int = 0) -> str:
            return full(groups[var][0], join(groups[var][1], p), depth + 1) if var in groups and depth < 9 else join("", p)

        for m in re.finditer(r"\b(\w+)\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any)\(\s*\"([^\"]*)\"\s*,(?:.*,)?\s*([\w.]+)\s*\)", text):
            yield m[2].upper(), full(m[1], m[3]), m[4], at(m.start())
        for m in re.finditer(r"\b(\w+)\.Handle\(\s*\"([A-Z]+)\"\s*,\s*\"([^\"]*)\"\s*,(?:.*,)?\s*([\w.]+)\s*\)", text):
            yield m[2], full(m[1], m[3]), m[4], at(m.start())
    elif lang == "csharp":
        c = re.search(r"\bclass\s+(\w+?)(?:Controller)?\b\s*(?::|\{)", text)
        b = re.search(r"\[Route\(\s*\"([^\"]*)\"", text)
        base = re.sub(r"\[controller\]", c[1].lower() if c else "", b[1]) if b else ""
        for m in re.finditer(r"\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*\"([^\"]*)\"\s*\))?\][^;{]*?\b(\w+)\s*\(", text):
            yield m[1].upper(), join(base, m[2] or ""), m[3], at(m.start())
        mapped = {m[1]: m[2] for m in re.finditer(r"(\w+)\s*=\s*\w+\.MapGroup\(\s*\"([^\"]*)\"", text)}
        for m in re.finditer(r"(\w+)?\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"\s*,\s*(?:async\s*)?([\w.]+)?", text):
            yield m[2].upper(), join(mapped.get(m[1] or "", ""), m[3]), m[4], at(m.start())


#: Types that a framework hands in and nobody declares.
_HANDED_IN = frozenset("String string int long bool boolean Integer Long Boolean double decimal IConfiguration ILogger".split())


def injected(path: str, text: str, lang: str) -> list[Link]:
    """What constructors of Spring, Nest and ASP.NET classes are handed in: depends_on links to the types."""
    out = []
    at = lambda p: text.count("\n", 0, p) + 1
    if lang == "java" and re.search(r"@(?:RestController|Controller|Service|Repository|Component)\b", text):
        for c in re.finditer(r"\bclass\s+(\w+)", text):
            m = re.compile(rf"\bpublic\s+{c[1]}\s*\(([^)]*)\)|@Autowired\s+(?:private\s+)?([A-Z]\w*(?:<[^>]*>)?\s+\w+)").search(text, c.end())
            for t in re.findall(r"([A-Z]\w*)(?:<[^>]*>)?\s+\w+", (m[1] or m[2] or "") if m else ""):
                out.append(Link(f"{path}::{c[1]}", "depends", t, None, None, at(m.start()), None, "spring"))
    elif lang == "typescript" and re.search(r"@(?:Controller|Injectable)\(", text):
        for c in re.finditer(r"\bclass\s+(\w+)", text):
            m = re.compile(r"\bconstructor\s*\(([^)]*)\)").search(text, c.end())
            for t in re.findall(r":\s*([A-Z]\w*)", m[1] if m else ""):
                out.append(Link(f"{path}::{c[1]}", "depends", t, None, None, at(m.start()), None, "nest"))
    elif lang == "csharp":
        for c in re.finditer(r"\bclass\s+(\w+(?:Controller|Service|Repository|Handler))\b", text):
            m = re.compile(rf"\bpublic\s+{c[1]}\s*\(([^)]*)\)").search(text, c.end())
            for t in re.findall(r"([A-Z]\w*)(?:<[^>]*>)?\s+\w+", m[1] if m else ""):
                out.append(Link(f"{path}::{c[1]}", "depends", t, None, None, at(m.start()), None, "aspnet"))
    elif lang == "python":
        for c in re.finditer(r"^@admin\.register\((\w+)[^)]*\)\s*\n(?:@[^\n]*\n)*class\s+(\w+)", text, re.M):
            out.append(Link(f"{path}::{c[2]}", "depends", c[1], None, None, at(c.start()), None, "django"))
    return [x for x in out if x.name not in _HANDED_IN]


def components(path: str, text: str, lang: str, symbols: list[Symbol]) -> list[Link]:
    """Components (capitalised functions and classes) that a component's source uses as elements, once each."""
    if lang not in ("javascript", "typescript") or not path.endswith((".jsx", ".tsx", ".js")):
        return []
    lines, out = text.splitlines(), []
    for s in symbols:
        if s.type in ("function", "class") and s.name[:1].isupper() and s.line_start:
            body = "\n".join(lines[s.line_start - 1 : s.line_end or len(lines)])
            for child in dict.fromkeys(re.findall(r"<([A-Z]\w*)[\s/>]", body)):
                if child != s.name:
                    out.append(Link(s.id, "element", child, None, None, s.line_start, None, "react"))
    return out


def middleware(text: str) -> Iterator[tuple[str, str]]:
    """Gin and Hertz: route path and each handler between the path and the last one."""
    for m in re.finditer(r"\b\w+\.(?:GET|POST|PUT|PATCH|DELETE|Any|Handle|HEAD|OPTIONS)\(\s*(?:\"[A-Z]+\"\s*,\s*)?\"([^\"]*)\"\s*,(.*)\)", text):
        for h in [x.strip() for x in m[2].split(",")][:-1]:
            if re.fullmatch(r"[\w.]+(?:\(\))?", h):
                yield m[1], h.rstrip("()")


# Fingerprints


def fingerprint(path: str, content: bytes | None) -> tuple[str, str, str, str, str]:
    """sha256 of the content, and of its structure, symbols, imports and calls; of an unreadable file all are that of the content.

    Comments, documentation and layout leave all but the first as they are.
    """
    raw = hashlib.sha256(content or b"").hexdigest()
    text, lang = decode(content), language_of(path)
    if not text or lang is None:
        return raw, raw, raw, raw, raw
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return raw, raw, raw, raw, raw
    symbols, links = extract(path, content)
    inside = lambda i: i.split("::", 1)[-1] if "::" in i else ""
    names = sorted(f"{s.type} {inside(s.id)} {re.sub(r'\s+', ' ', s.signature or '')}" for s in symbols if s.type != "file")
    imports = sorted(f"{x.module} {x.name}" for x in links if x.kind == "import")
    calls = sorted(f"{inside(x.source)} {x.qualifier} {x.name}" for x in links if x.kind != "import")
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    return raw, sha([*names, "-", *imports, "-", *calls]), sha(names), sha(imports), sha(calls)
