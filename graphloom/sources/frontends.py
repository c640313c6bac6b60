"""What a source file declares, calls, serves, asks for, publishes and queries.

``parse_braced`` reads languages with braces by their tokens, ``python_sites`` Python by
its syntax tree. A site (src, kind, framework, method, literal, folded, mode, line) is a
place that speaks to the outside: http, publish, listen or query. ``literal`` is a text as
written; ``folded`` is what constants give of an expression, with ``${}`` for the rest.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterable, Iterator

from ..operators.similarity import body_signature
from .lexing import KEYWORDS, Definition, Source, value_of

# Methods of HTTP clients and of route registrations, and their verbs.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
SPRING_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
JAXRS_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
NEST_VERBS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH", "Head": "HEAD", "Options": "OPTIONS", "All": "ALL"}
GRAPHQL_VERBS = {"Query": "QUERY", "Mutation": "MUTATION", "Subscription": "SUBSCRIPTION"}
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH"}
GO_CLIENT = {"Get": "GET", "Head": "HEAD", "Post": "POST", "PostForm": "POST"}
GO_ROUTERS = {"github.com/gin-gonic/gin": "upper", "github.com/labstack/echo": "upper", "github.com/go-chi/chi": "title", "net/http": "handle", "github.com/gorilla/mux": "handle"}
# Calls that run SQL, and operations of object mappers and query builders.
STATEMENT_CALLS = ("prepareStatement", "executeQuery", "executeUpdate")
TEMPLATE_CALLS = ("query", "update", "queryForObject", "queryForList", "queryForMap", "batchUpdate")
MAPPER_READS = frozenset("find findOne findById findByPk findAll findMany findUnique findFirst findUniqueOrThrow count aggregate groupBy exists distinct select first pluck".split())
MAPPER_WRITES = frozenset("create createMany save insert insertMany bulkCreate update updateOne updateMany upsert delete deleteOne deleteMany destroy remove findOneAndUpdate findOneAndDelete findByIdAndUpdate findByIdAndDelete del increment decrement".split())
SQL = re.compile(r"\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|CALL|WITH)\b", re.IGNORECASE)
# Names of types that stand for a language's own ones in a fingerprint.
BASIC_TYPES = frozenset("int long short byte char float double boolean bool string number any unknown never object void usize isize u8 u16 u32 u64 i8 i16 i32 i64 f32 f64 str Int Long String Boolean Double Float Unit Any error rune uint".split())

IMPORTS = {
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "kotlin": r"^\s*import\s+([\w.*]+)", "scala": r"^\s*import\s+([\w.{}, ]+)", "csharp": r"^\s*using\s+([\w.]+)\s*;", "rust": r"^\s*(?:pub\s+)?use\s+([\w:{}*, ]+);",
    "c": r"^\s*#include\s*[<\"]([^>\"]+)", "cpp": r"^\s*#include\s*[<\"]([^>\"]+)", "php": r"^\s*use\s+([\w\\]+)", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$",
    "typescript": r"(?:\bfrom\s*|\bimport\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)[\"']([^\"'\n]+)[\"']", "javascript": r"(?:\bfrom\s*|\bimport\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)[\"']([^\"'\n]+)[\"']",
}


def parse_braced(file: str, text: str, language: str) -> dict:
    """Definitions, imports, references, routes, heritage, constants and sites of a file."""
    return Unit(file, text, language).facts()


def route_path(*parts: str) -> str:
    path = re.sub("/+", "/", "/" + "/".join(p for p in parts if p))
    return path.rstrip("/") or "/"


class Unit:
    def __init__(self, file: str, text: str, language: str):
        self.file, self.language, self.source = file, language, Source(text, language)
        package = re.search(r"^\s*package\s+([\w.]+)", text, re.MULTILINE) if language in ("java", "kotlin", "scala") else None
        self.prefix = (package[1] + "." if package else "") if language in ("java", "kotlin", "scala") else re.sub(r"\.\w+$", "", file).replace("/", ".") + "."
        self.imports = list(dict.fromkeys(re.findall(IMPORTS[language], text, re.MULTILINE)))
        self.annotations = self._annotations()
        self.constants = self._constants()
        self.bindings = self._bindings()
        self.sites: list[dict] = []
        self.routes: list[dict] = []

    # Names.

    def ident(self, d: Definition | None) -> str:
        if d is None:
            return f"File:{self.file}"
        if d.kind == "type":
            kind = d.word.capitalize() if self.language == "java" else "Interface" if d.word in ("interface", "trait") else "Class"
            return f"{kind}:{self.prefix}{d.name}"
        if d.owner is not None:
            return f"Method:{self.prefix}{d.owner}#{d.name}/{self.source.arity(d)}"
        return f"Function:{self.prefix.rstrip('.')}#{d.name}" + (f"/{self.source.arity(d)}" if self.language in ("kotlin", "scala", "java") else "")

    def imported(self, *names: str) -> bool:
        """Does the file import one of the packages, or a part of one?"""
        return any(i == n or i.startswith((n + "/", n + ".")) for i in self.imports for n in names)

    def _annotations(self) -> dict[int, list[tuple[str, dict[str, list[str]], list[str]]]]:
        """By the place of a definition's name: name, texts by key and bare names of each annotation before it."""
        s, found = self.source, {}
        places = {d.at for d in s.types} | {d.at for d in s.callables}
        pending, i = [], 0
        while i < len(s.tokens):
            if s.text(i) == "@" and s.is_name(i + 1) and s.text(i + 1) != "interface":
                at, k = s.inside[i], i + 1
                while s.text(k + 1) == "." and s.is_name(k + 2):
                    k += 2
                name, values, names = s.text(k), {}, []
                if s.text(k + 1) == "(":
                    for a, b in s.arguments(k + 1):
                        key = s.text(a) if s.text(a + 1) in ("=", ":") else "value"
                        values.setdefault(key, []).extend(value_of(t) for t in s.tokens[a:b] if t.kind == "string")
                        names += [t.text for t in s.tokens[a:b] if t.kind == "name"]
                    k = s.partner[k + 1]
                pending.append((at, (name, values, names)))
                i = k + 1
                continue
            if i in places:
                found[i] = [x for at, x in pending if at == s.inside[i]]
                pending = [p for p in pending if p[0] != s.inside[i]]
            elif s.text(i) in (";", "}") and s.tokens[i].kind == "op":
                pending = [p for p in pending if p[0] != s.inside[i]]
            i += 1
        return found

    def _constants(self) -> dict[str, str]:
        """Names that a text is assigned to once, also as owner.name."""
        s, found, twice = self.source, {}, set()
        for i, t in enumerate(s.tokens):
            if t.kind == "string" and s.text(i - 1) in ("=", ":=") or t.kind == "string" and s.text(i - 1) == "=" and s.text(i - 2) == ":":
                k = i - 2 - (s.text(i - 2) == ":")
                if s.text(k - 1) == ":" and s.is_name(k - 2):  # name: type = text
                    k -= 2
                if not s.is_name(k) or s.text(i + 1) in ("+", ".", "%"):
                    continue
                owner = s.type_at(k)
                for name in (s.text(k), *([f"{owner.name}.{s.text(k)}"] if owner is not None else [])):
                    if name in found:
                        twice.add(name)
                    found[name] = value_of(t)
        return {k: v for k, v in found.items() if k not in twice}

    def _bindings(self) -> dict[str, str]:
        """Types of names: ``Type name`` or ``name: Type``; the first of a name counts."""
        s, found = self.source, {}
        for i, t in enumerate(s.tokens):
            if t.kind != "name" or not t.text[:1].isupper():
                continue
            if self.language in ("kotlin", "typescript", "scala", "rust") and s.text(i - 1) == ":" and s.is_name(i - 2):
                found.setdefault(s.text(i - 2), t.text)
            elif self.language in ("java", "csharp", "cpp"):
                k = i + 1
                if s.text(k) == "<":
                    depth = 0
                    while k < len(s.tokens):
                        depth += (s.text(k) == "<") - (s.text(k) == ">")
                        k += 1
                        if not depth:
                            break
                if s.is_name(k) and s.text(k) not in KEYWORDS and s.text(k + 1) in (";", "=", ",", ")", ":"):
                    found.setdefault(s.text(k), t.text)
        return found

    # Values.

    def literal(self, a: int, b: int) -> str | None:
        """A text as it is written, if the argument is one and nothing is put into it."""
        s = self.source
        if b - a != 1 or s.tokens[a].kind != "string":
            return None
        t = s.tokens[a]
        holes = t.text.startswith("`") and "${" in t.text or self.language == "kotlin" and re.search(r"\$[\w{]", t.text)
        return None if holes else value_of(t)

    def folded(self, a: int, b: int) -> str | None:
        """The argument with constants in their places and ``${}`` for what isn't known; None without any text."""
        s, parts, i = self.source, [], a
        if a >= b:
            return None
        if s.text(a) in ("fmt", "String") and s.text(a + 2) in ("Sprintf", "format") and s.text(a + 3) == "(":
            inner = s.arguments(a + 3)
            text = self.literal(*inner[0]) if inner else None
            return None if text is None else re.sub(r"%%|%[^a-zA-Z%]*[a-zA-Z]", lambda m: "%" if m[0] == "%%" else "${}", text)
        while i < b:
            end = next((k for k in self._tops(i, b) if s.text(k) == "+"), b)
            t = s.tokens[i]
            if end - i == 1 and t.kind == "string":
                hole = (lambda m: self.constants.get(m[1] or m[2], "${}")) if t.text.startswith("`") or self.language == "kotlin" else (lambda m: m[0])
                parts.append(re.sub(r"\$\{([^{}]*)\}|\$(\w+)", hole, value_of(t)))
            else:
                name = "".join(x.text for x in s.tokens[i:end])
                parts.append(self.constants.get(name, self.constants.get(name.removeprefix("this."), "${}")))
            i = end + 1
        whole = "".join(parts)
        return whole if whole.replace("${}", "") else None

    def _tops(self, a: int, b: int) -> Iterator[int]:
        while a < b:
            yield a
            a = self.source.past(a) if self.source.partner[a] > a else a + 1

    def pair(self, a: int, b: int, key: str) -> tuple[int, int] | None:
        """The value of a key in ``{ key: value, ... }``."""
        s = self.source
        if a >= b or s.text(a) != "{":
            return None
        for x, y in s.arguments(a):
            if s.text(x).strip("\"'") == key and s.text(x + 1) == ":":
                return x + 2, y
        return None

    def site(self, at: int, kind: str, framework: str, method: str | None, place: tuple[int, int] | None = None, literal: str | None = None, mode: str | None = None, prefix: str = "") -> None:
        folded = None
        if place is not None:
            literal, folded = self.literal(*place), self.folded(*place)
            if prefix:
                literal, folded = (None if x is None or "://" in x else route_path(prefix, x) for x in (literal, folded))
        if literal is None and folded is None:
            return
        holder = self.source.callable_at(at)
        self.sites.append({"src": self.ident(holder), "kind": kind, "framework": framework, "method": method, "literal": literal, "folded": folded, "mode": mode, "line": self.source.line(at)})

    def route(self, method: str, path: str, handler: str | None, framework: str) -> None:
        self.routes.append({"method": method, "path": path, "handler": handler, "framework": framework})

    # Rules.

    def facts(self) -> dict:
        s = self.source
        defs = []
        for d in s.types:
            last = s.line(d.body[1]) if d.body is not None else s.line(d.at)
            defs.append({"id": self.ident(d), "kind": self.ident(d).split(":", 1)[0], "name": d.name, "first": s.line(d.at), "last": last, "cyclomatic": 0, "cognitive": 0, "loop_depth": 0, "leaf_tokens": 0, "minhash": None})
        for d in s.callables:
            a, b = d.body or (0, 0)
            classes = [] if d.body is None else self.classes(a, b)
            defs.append({"id": self.ident(d), "kind": self.ident(d).split(":", 1)[0], "name": d.name, "first": s.line(d.at), "last": s.line(b) if d.body is not None else s.line(d.at), **s.complexity(a, b), "leaf_tokens": len(classes), "minhash": body_signature(classes)})
        if self.language in ("java", "kotlin"):
            self._spring()
            self._java_calls()
        elif self.language in ("typescript", "javascript"):
            self._decorated()
            self._file_routes()
            self._script_calls()
        elif self.language == "go":
            self._go_calls()
        refs = [{"name": s.text(i), "owner": self.ident(s.callable_at(i)), "line": s.line(i)} for i, *_ in s.calls()]
        return {
            "defs": defs, "imports": [{"raw": r, "is_wildcard": r.endswith("*")} for r in self.imports], "refs": refs, "routes": self.routes, "sites": self.sites,
            "heritage": list(self._heritage()), "constants": [{"name": k, "value": v} for k, v in self.constants.items()], "bindings": [{"name": k, "type": v} for k, v in self.bindings.items()],
        }

    def classes(self, a: int, b: int) -> list[str]:
        """Each token's class: I identifier, S text, N number, T type, K keyword; others, as all punctuation, are none."""
        out = []
        for t in self.source.tokens[a:b]:
            if t.kind in ("string", "number"):
                out.append("SN"[t.kind == "number"])
            elif t.kind == "name":
                out.append("T" if t.text in BASIC_TYPES else "K" if t.text in KEYWORDS else "T" if t.text[:1].isupper() and not t.text.isupper() else "I")
        return out

    def _heritage(self) -> Iterator[dict]:
        """child, parent (its simple name) and kind: extends or implements."""
        s = self.source
        for d in s.types:
            if d.word == "impl":
                at = d.at - 1
                if s.text(at) == "for":
                    names = s._outer_names(max(0, at - 40), at)
                    if names:
                        yield {"child": self.ident(d), "parent": s.text(names[-1]), "kind": "implements"}
                continue
            if d.body is None and self.language != "kotlin":
                continue
            kind, depth, i = None, 0, d.at + 1
            end = d.body[0] - 1 if d.body is not None else s.line_end(d.at)
            named: list[tuple[str, str]] = []
            while i < end:
                t = s.text(i)
                depth += (t == "<") - (t == ">")
                if t in ("extends", "implements", "with"):
                    kind = "implements" if t != "extends" else "extends"
                elif t == ":" and self.language in ("kotlin", "csharp", "cpp"):
                    kind = "extends"
                elif kind is not None and not depth and s.is_name(i) and s.text(i + 1) != "." and t not in ("public", "private", "protected", "virtual"):
                    called = s.text(i + 1) == "("
                    own = "implements" if self.language == "kotlin" and not called or self.language == "csharp" and re.match("I[A-Z]", t) else kind
                    named.append((t, "extends" if d.word == "interface" else own))
                i = s.past(i) if s.partner[i] > i else i + 1
            for parent, how in dict.fromkeys(named):
                yield {"child": self.ident(d), "parent": parent, "kind": how}

    def _mappings(self, at: int) -> list[tuple[str, str, str]]:
        """Verb, path and framework of what a definition's annotations serve."""
        out = []
        marks = self.annotations.get(at, [])
        path = next((v.get("value", [""])[0] if v.get("value") else "" for n, v, _ in marks if n == "Path"), "")
        for name, values, names in marks:
            paths = values.get("value", []) + values.get("path", [])
            if name in SPRING_VERBS:
                out += [(SPRING_VERBS[name], p, "spring") for p in paths or [""]]
            elif name == "RequestMapping":
                verbs = [n for n in names if n in JAXRS_VERBS] or ["ANY"]
                out += [(v, p, "spring") for v in verbs for p in paths or [""]]
            elif name in JAXRS_VERBS:
                out.append((name, path, "jaxrs"))
        return out

    def _spring(self) -> None:
        """Routes of Spring and JAX-RS, proxies, listeners."""
        s = self.source
        for d in s.callables:
            around = s.type_at(d.at)
            outer = self.annotations.get(around.at, []) if around is not None else []
            proxy = next((v for n, v, _ in outer if n == "FeignClient"), None)
            base = next(((v.get("value") or v.get("path") or [""])[0] for n, v, _ in outer if n in ("RequestMapping", "Path")), "")
            for verb, path, framework in self._mappings(d.at):
                if proxy is not None:
                    first = next((x for k in ("url", "path", "value") for x in proxy.get(k, [])), "")
                    url = route_path(first, path) if first.startswith("/") else path
                    self.sites.append({"src": self.ident(d), "kind": "http", "framework": "feign", "method": verb, "literal": url, "folded": url, "mode": "proxy", "line": s.line(d.at)})
                else:
                    self.route(verb, route_path(base, path), self.ident(d), framework)
            for name, values, _ in self.annotations.get(d.at, []):
                topics, framework = [], "kafka"
                if name == "KafkaListener":
                    topics = [x for k in ("topics", "topic", "value") for x in values.get(k, [])]
                elif name == "EventListener":
                    types = [x.text for x in s.tokens[d.params[0] : d.params[1]] if x.kind == "name" and x.text[:1].isupper()]
                    topics, framework = types[:1], "spring"
                self.sites += [{"src": self.ident(d), "kind": "listen", "framework": framework, "method": None, "literal": x, "folded": x, "mode": None, "line": s.line(d.at)} for x in topics]

    def _java_calls(self) -> None:
        s = self.source
        for i, receiver, root, start in s.calls():
            name, args = s.text(i), s.arguments(start)
            kind = self.bindings.get(receiver.removeprefix("this."))
            if kind == "RestTemplate" and name in REST_TEMPLATE and args:
                self.site(i, "http", "resttemplate", REST_TEMPLATE[name], args[0])
            elif name == "uri" and args and self.bindings.get(root if root != "this" else receiver.split(".")[1]) == "WebClient":
                verb = next((v for v in VERBS[:5] if f".{v}()" in receiver), None)
                if verb is not None:
                    self.site(i, "http", "webclient", verb.upper(), args[0])
            elif kind == "KafkaTemplate" and name == "send" and args:
                self.site(i, "publish", "kafka", None, args[0])
            elif kind == "ApplicationEventPublisher" and name == "publishEvent" and args:
                first = args[0][0] + (s.text(args[0][0]) == "new")
                if s.text(first)[:1].isupper():
                    self.site(i, "publish", "spring", None, literal=s.text(first))
            elif args and (name in STATEMENT_CALLS or name in TEMPLATE_CALLS and str(kind).endswith("JdbcTemplate")):
                text = self.literal(*args[0]) or self.folded(*args[0])
                if text is not None and SQL.match(text):
                    self.site(i, "query", "jdbc", name, args[0])

    def _decorated(self) -> None:
        """Routes and operations that decorators declare."""
        s = self.source
        for d in s.callables:
            around = s.type_at(d.at)
            outer = self.annotations.get(around.at, []) if around is not None else []
            base = next((v["value"][0] for n, v, _ in outer if n == "Controller" and v.get("value")), "")
            for name, values, _ in self.annotations.get(d.at, []):
                path = (values.get("value") or [""])[0]
                if name in NEST_VERBS and any(n == "Controller" for n, *_ in outer):
                    self.route(NEST_VERBS[name], route_path(base, path), self.ident(d), "nestjs")
                elif name in GRAPHQL_VERBS and any(n == "Resolver" for n, *_ in outer):
                    self.route(GRAPHQL_VERBS[name], path or d.name, self.ident(d), "graphql")

    def _file_routes(self) -> None:
        """Routes that a file's place says."""
        path = self.file.removeprefix("src/")
        stem = re.sub(r"\.[jt]sx?$", "", path)
        dynamic = lambda x: ":" + x.strip("[]").removeprefix("...") if x.startswith("[") else x
        s = self.source
        exported = {s.text(k) for i, t in enumerate(s.tokens) if t.text == "export" for k in (i + 2 + (s.text(i + 1) == "async"),) if s.text(k - 1) in ("function", "const", "let", "var")}
        if found := re.search(r"(?:^|/)pages/api/(.+)$", stem):
            parts = [dynamic(x) for x in found[1].split("/")]
            self.route("ALL", route_path("api", *(parts[:-1] if parts[-1] == "index" else parts)), None, "nextjs")
        elif found := re.search(r"(?:^|/)app/((?:.*/)?)route$", stem):
            parts = [dynamic(x) for x in found[1].split("/") if x and not x.startswith(("(", "@"))]
            for verb in JAXRS_VERBS:
                if verb in exported:
                    self.route(verb, route_path(*parts), f"Function:{self.prefix.rstrip('.')}#{verb}", "nextjs")
        elif found := re.search(r"(?:^|/)app/routes/(.+)$", stem):
            parts = ["*" if x == "$" else ":" + x[1:] if x.startswith("$") else x for x in re.split(r"[/.]", found[1].removesuffix("/route")) if x and not x.startswith("_")]
            for name, verb in (("loader", "GET"), ("action", "POST")):
                if name in exported:
                    self.route(verb, route_path(*parts), f"Function:{self.prefix.rstrip('.')}#{name}", "remix")

    def _script_calls(self) -> None:
        s = self.source
        clients, models, queues = {}, {}, {}
        for i, receiver, _, start in s.calls():  # what names stand for
            args, at = s.arguments(start), i
            while s.text(at - 1) in (".", "?."):
                at -= 2
            at -= s.text(at - 1) == "new"
            if s.text(at - 1) != "=" or not s.is_name(at - 2) or not args:
                continue
            name, call = s.text(at - 2), f"{receiver}.{s.text(i)}" if receiver else s.text(i)
            if call == "axios.create":
                base = self.pair(*args[0], "baseURL")
                clients[name] = (self.literal(*base) if base is not None else None) or ""
            elif call in ("model", "mongoose.model") or s.text(i) == "define":
                models[name] = self.literal(*args[0])
            elif call == "Queue":
                queues[name] = self.literal(*args[0])
        for i, receiver, root, start in s.calls():
            name, args = s.text(i), s.arguments(start)
            if not args:
                continue
            last = receiver.split(".")[-1].lstrip("?")
            verb = name.upper() if name in VERBS else None
            if not receiver and (name in ("fetch", "axios", "$fetch", "ofetch") or name in ("got", "ky") and self.imported(name)):
                how = self.pair(*args[1], "method") if len(args) > 1 else None
                self.site(i, "http", name, (self.literal(*how) or "GET").upper() if how is not None else "GET", args[0])
            elif verb is not None and (receiver == "axios" or receiver in clients or receiver in ("ky", "superagent", "undici") and self.imported(receiver)):
                self.site(i, "http", "axios" if receiver in clients else receiver, verb, args[0], prefix=clients.get(receiver, ""))
            elif verb is not None and last in ("http", "httpClient", "httpService") and self.imported("@angular/common/http", "@nestjs/axios"):
                self.site(i, "http", "httpclient", verb, args[0])
            elif name in ("emit", "on") and receiver and self.imported("socket.io", "socket.io-client"):
                self.site(i, "publish" if name == "emit" else "listen", "socketio", None, args[0])
            elif name in ("send", "subscribe") and receiver and self.imported("kafkajs") and (topic := self.pair(*args[0], "topic")) is not None:
                self.site(i, "publish" if name == "send" else "listen", "kafka", None, topic)
            elif name == "add" and queues.get(receiver) and self.imported("bull", "bullmq"):
                self.site(i, "publish", "bull", None, literal=queues[receiver])
            elif name in ("sendToQueue", "publish", "consume") and receiver and self.imported("amqplib"):
                self.site(i, "listen" if name == "consume" else "publish", "rabbitmq", None, args[0])
            elif name == "route" and (receiver == "server" and self.imported("@hapi/hapi", "hapi") or receiver in ("fastify", "app") and self.imported("fastify")):
                self._declared_route(args[0], "hapi" if receiver == "server" else "fastify", "path" if receiver == "server" else "url")
            elif receiver in ("app", "router", "express", "fastify") and (text := self.literal(*args[0])) is not None:
                framework = "fastify" if receiver == "fastify" or receiver == "app" and self.imported("fastify") and not self.imported("express") else "koa" if receiver == "router" and self.imported("koa", "@koa/router") and not self.imported("express") else "express"
                if verb is not None and (framework != "express" or name in VERBS[:5]) or name == "all" and framework != "express":
                    own = next((d for d in s.callables if len(args) > 1 and args[-1][1] - args[-1][0] == 1 and d.name == s.text(args[-1][0]) and d.owner is None), None)
                    self.route(name.upper(), route_path(text), self.ident(own) if own is not None else None, framework)
            self._mapper(i, receiver, root, name, models)
        for i, receiver, root, start in s.calls():  # calls without arguments query too
            if not s.arguments(start):
                self._mapper(i, receiver, root, s.text(i), models)

    def _declared_route(self, place: tuple[int, int], framework: str, key: str) -> None:
        """A route that an object declares, with one verb or several."""
        s, path = self.source, self.pair(*place, key)
        text = self.literal(*path) if path is not None else None
        if text is None:
            return
        verbs = self.pair(*place, "method")
        for verb in [value_of(t).upper() for t in s.tokens[verbs[0] : verbs[1]] if t.kind == "string"] if verbs is not None else ["ALL"]:
            self.route(verb, route_path(text), None, framework)

    def _mapper(self, i: int, receiver: str, root: str, name: str, models: dict[str, str | None]) -> None:
        """A query through an object mapper or a query builder: its table and whether it reads or writes."""
        if name not in MAPPER_READS | MAPPER_WRITES or not receiver:
            return
        mode = "Write" if name in MAPPER_WRITES else "Read"
        parts = receiver.removeprefix("this.").split(".")
        if len(parts) == 2 and (parts[0] == "prisma" or parts[0] == "db" and self.imported("@prisma/client")):
            self.site(i, "query", "prisma", name, literal=parts[1], mode=mode)
        elif models.get(receiver):
            self.site(i, "query", "orm", name, literal=models[receiver], mode=mode)
        elif (found := re.match(r"(knex|db)\([\"']([^\"']+)[\"']\)", receiver)) and (found[1] == "knex" or self.imported("knex")):
            self.site(i, "query", "knex", name, literal=found[2], mode=mode)

    def _go_calls(self) -> None:
        s = self.source
        styles = {style for package, style in GO_ROUTERS.items() if self.imported(package) or any(x.startswith(package) for x in self.imports)}
        functions = {d.name: d for d in s.callables if d.owner is None}
        for i, receiver, _, start in s.calls():
            name, args = s.text(i), s.arguments(start)
            if not receiver or not args:
                continue
            text = self.literal(*args[0])
            verb, path = None, text or ""
            if "upper" in styles and name in JAXRS_VERBS or "title" in styles and name in [v.capitalize() for v in VERBS]:
                verb = name.upper()
            elif "handle" in styles and name in ("HandleFunc", "Handle"):
                word, _, rest = path.partition(" ")
                verb, path = (word, rest) if word in JAXRS_VERBS and rest else ("ANY", path)
            if verb is not None and path.startswith("/"):
                handler = functions.get(s.text(args[1][0])) if len(args) > 1 and args[1][1] - args[1][0] == 1 else None
                self.route(verb, path, self.ident(handler) if handler is not None else None, "go")
            elif receiver == "http" and self.imported("net/http"):
                if name in GO_CLIENT:
                    self.site(i, "http", "nethttp", GO_CLIENT[name], args[0])
                elif name in ("NewRequest", "NewRequestWithContext"):
                    first = int(name != "NewRequest")
                    if len(args) > first + 1 and (method := self.literal(*args[first])) is not None:
                        self.site(i, "http", "nethttp", method.upper(), args[first + 1])


# Python.


def python_constants(tree: ast.Module) -> dict[str, str]:
    found = {}
    for n in tree.body:
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            found |= {t.id: n.value.value for t in n.targets if isinstance(t, ast.Name)}
    return found


def python_text(node: ast.expr, constants: dict[str, str]) -> tuple[str | None, str | None]:
    """literal and folded of an expression."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value, node.value

    def fold(n: ast.expr) -> str:
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            return n.value
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            return fold(n.left) + fold(n.right)
        if isinstance(n, ast.JoinedStr):
            return "".join(fold(v.value) if isinstance(v, ast.FormattedValue) else fold(v) for v in n.values)
        return constants.get(n.id, "${}") if isinstance(n, ast.Name) else "${}"

    whole = fold(node)
    return None, whole if whole.replace("${}", "") else None


def python_site(call: ast.Call, owner: str, constants: dict[str, str]) -> dict | None:
    """A call of requests or httpx, or of a cursor with SQL."""
    f, method, at, kind = call.func, None, 0, "http"
    if not isinstance(f, ast.Attribute):
        return None
    base = f.value.id if isinstance(f.value, ast.Name) else ""
    if base in ("requests", "httpx"):
        if f.attr in VERBS:
            method = f.attr.upper()
        elif f.attr == "request" and call.args and isinstance(call.args[0], ast.Constant):
            method, at = str(call.args[0].value).upper(), 1
    elif f.attr in ("execute", "executemany"):
        method, kind = f.attr, "query"
    if method is None or len(call.args) <= at:
        return None
    literal, folded = python_text(call.args[at], constants)
    if (literal or folded) is None or kind == "query" and not SQL.match(literal or folded or ""):
        return None
    return {"src": owner, "kind": kind, "framework": "dbapi" if kind == "query" else base, "method": method, "literal": literal, "folded": folded, "mode": None, "line": call.lineno}


def python_classes(text: str) -> dict[int, list[str]]:
    """The classes of a file's tokens, by line."""
    import keyword

    out: dict[int, list[str]] = {}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            mark = "S" if t.type in (tokenize.STRING, tokenize.FSTRING_START) else "N" if t.type == tokenize.NUMBER else ("K" if keyword.iskeyword(t.string) else "I") if t.type == tokenize.NAME else None
            if mark is not None:
                out.setdefault(t.start[0], []).append(mark)
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def python_cognitive(node: ast.AST, nesting: int = 0) -> int:
    """1 and the depth of nesting for each construct, 1 for each logical operator; a lambda begins anew."""
    total = 0
    for child in ast.iter_child_nodes(node):
        deeper = nesting
        if isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.Match)):
            total, deeper = total + 1 + nesting, nesting + 1
        elif isinstance(child, ast.IfExp):
            total += 1 + nesting
        elif isinstance(child, ast.BoolOp):
            total += len(child.values) - 1
        elif isinstance(child, ast.Lambda):
            deeper = 0
        total += python_cognitive(child, deeper)
    return total


def python_signature(lines: dict[int, list[str]], first: int, last: int) -> tuple[int, list[int] | None]:
    classes = [c for line in range(first, last + 1) for c in lines.get(line, ())]
    return len(classes), body_signature(classes)


def heritage_of(classes: Iterable[tuple[str, ast.ClassDef]]) -> list[dict]:
    """Base classes by their last name."""
    name = lambda b: b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
    return [{"child": ident, "parent": n, "kind": "extends"} for ident, c in classes for b in c.bases if (n := name(b)) is not None]
