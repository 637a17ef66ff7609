"""Symbols and call sites of Java source, with what is known about the types of receivers and arguments.

A callable's id is provisional, `class#signature`; qualifying parameter types needs the catalogue of all
classes, so that is left to joins. A call's receiver is given as the type name that its scope declares.
"""

from __future__ import annotations

from .lexing import OPENERS, Cursor, SourceError

MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
PRIMITIVES = set("boolean byte short int long float double char void".split())
NOT_NAMES = set("if else while for do try catch finally switch case return throw new instanceof this super null true false break continue assert synchronized yield class interface enum".split())


def simple(text: str) -> str:
    return text.split("<", 1)[0].rsplit(".", 1)[-1].strip()


class JavaFile:
    def __init__(self, path: str, source: str, calls: bool = True):
        self.path, self.c, self.calls = path, Cursor(source, False), calls
        self.symbols: list[dict] = []
        self.sites: list[dict] = []
        self.package, self.imports, self.wildcards = "", {}, []
        self.scopes: list[dict[str, str]] = []
        self.blocks: list[tuple[int, dict[str, str]]] = []

    def add(self, **row) -> dict:
        row |= {"file_path": self.path, "language": "JAVA", "package": self.package}
        self.symbols.append(row)
        return row

    def read(self) -> JavaFile:
        c = self.c
        while not c.done:
            if c.is_("package", "import"):
                kind = c.texts[c.at]
                c.at += 1
                static = c.take("static")
                start = c.at
                while not c.done and not c.is_(";"):
                    c.at += 1
                name = "".join(c.texts[start : c.at])
                c.take(";")
                if kind == "package":
                    self.package = name
                elif not static:
                    if name.endswith(".*"):
                        self.wildcards.append(name[:-2])
                    else:
                        self.imports[name.rsplit(".", 1)[-1]] = name
                continue
            self.member(None, None)
        return self

    # --- declarations ---

    def class_id(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def prefix(self) -> tuple[list[dict], list[str]]:
        c, annotations, modifiers = self.c, [], []
        while True:
            text = c.texts[c.at]
            if text == "@" and not c.is_("interface", ahead=1):
                annotations.append(self.annotation())
            elif text in MODIFIERS and not (text == "default" and c.is_(":", "->", ahead=1)):
                modifiers.append(text)
                c.at += 1
            elif text == "non" and c.is_("-", ahead=1):
                c.at += 3
            else:
                return annotations, modifiers

    def annotation(self) -> dict:
        c = self.c
        c.take("@")
        start = c.at
        c.at += 1
        while c.is_("."):
            c.at += 2
        name, args = c.text(start, c.at).replace(" ", ""), []
        if c.is_("("):
            for i, j in c.parts(c.at + 1, c.partner[c.at], angles=False):
                key = ""
                if c.kinds[i] == "id" and c.texts[i + 1] == "=":
                    key, i = c.texts[i], i + 2
                args.append({"name": key, "value": c.text(i, j)})
            c.at = c.past(c.at)
        return {"name": name.rsplit(".", 1)[-1], "label": f"@{name}", "args": args}

    def type_end(self, i: int) -> int:
        """The place after a type that starts at i, or i."""
        c, begin = self.c, i
        while c.texts[i] == "@" and c.kinds[i] == "op":
            i += 2
        if c.kinds[i] != "id" or c.texts[i] in NOT_NAMES:
            return begin
        while True:
            i += 1
            if c.texts[i] == "<" and c.kinds[i] == "op":
                after = c.type_arguments(i)
                if not after:
                    return begin
                i = after
            if c.texts[i] == "." and c.kinds[i + 1] == "id":
                i += 1
                continue
            break
        while (c.texts[i] == "[" and c.texts[i + 1] == "]") or c.texts[i] == "...":
            i += 2 if c.texts[i] == "[" else 1
        return i

    def types(self) -> list[str]:
        """Type names separated by commas."""
        c, out = self.c, []
        while True:
            end = self.type_end(c.at)
            if end == c.at:
                return out
            out.append(simple(c.text(c.at, end)))
            c.at = end
            if not c.take(",", "&"):
                return out

    def member(self, owner: dict | None, owner_id: str | None) -> None:
        c = self.c
        start = c.at
        if c.take(";"):
            return
        annotations, modifiers = self.prefix()
        if c.is_("class", "interface", "@", "enum", "record") and (c.is_("class", "interface") or (c.is_("@") and c.is_("interface", ahead=1)) or (c.is_("enum", "record") and c.kinds[c.at + 1] == "id" and c.texts[c.at + 2] in ("{", "(", "implements", "<"))):
            self.class_(start, annotations, owner, owner_id)
            return
        if c.is_("{"):
            c.at = c.past(c.at)
            return
        if c.is_("<"):
            c.at = c.type_arguments(c.at) or c.at + 1
        name = c.texts[c.at]
        if c.kinds[c.at] == "id" and c.is_("(", ahead=1):
            c.at += 1
            self.callable_(start, annotations, modifiers, name, name, "CONSTRUCTOR", owner_id)
            return
        end = self.type_end(c.at)
        if end == c.at:
            c.at = c.past(c.at) if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op" else c.at + (not c.done)
            return
        type_ = c.text(c.at, end)
        c.at = end
        name = c.texts[c.at]
        if c.is_("(", ahead=1):
            c.at += 1
            self.callable_(start, annotations, modifiers, name, type_, "METHOD", owner_id)
            return
        # Fields: one row for each declarator.
        while c.kinds[c.at] == "id":
            name, own = c.texts[c.at], type_
            c.at += 1
            while c.is_("[") and c.is_("]", ahead=1):
                own += "[]"
                c.at += 2
            class_id = owner_id or "unknown-class"
            self.add(id=f"{class_id}#{name}", kind="FIELD", declaring_class_id=class_id, name=name, field_type=own, line=c.lines[start], annotations=[a["label"] for a in annotations], raw_annotations=annotations, injection="FIELD", supertypes=[])
            if owner is not None:
                owner["field_ids"].append(f"{class_id}#{name}")
            if c.take("="):
                while not c.done and not c.is_(",", ";"):
                    if c.is_("<") and (after := c.type_arguments(c.at)):
                        c.at = after
                    else:
                        c.at = c.past(c.at) if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op" else c.at + 1
            if not c.take(","):
                break
        c.take(";")

    def class_(self, start: int, annotations: list[dict], owner: dict | None, owner_id: str | None) -> None:
        c = self.c
        c.take("@")
        kind = c.texts[c.at]
        c.at += 1
        name = c.texts[c.at]
        c.at += 1
        counted = kind in ("class", "interface") and c.texts[c.at - 3] != "@"
        if c.is_("<"):
            c.at = c.type_arguments(c.at) or c.at + 1
        if kind == "record" and c.is_("("):
            c.at = c.past(c.at)
        extends, implements = [], []
        while c.is_("extends", "implements", "permits"):
            word = c.texts[c.at]
            c.at += 1
            found = self.types()
            if word == "extends":
                extends = found
            elif word == "implements":
                implements = found
        class_id = self.class_id(name) if counted else owner_id
        row = None
        if counted:
            row = {"id": class_id, "kind": "CLASS", "simple_name": name, "line": c.lines[start], "annotations": [a["label"] for a in annotations], "raw_annotations": annotations, "super_class": extends[0] if extends else "", "interfaces": implements, "supertypes": extends, "parents": extends + implements, "field_ids": [], "method_ids": [], "imports": dict(self.imports), "wildcards": list(self.wildcards)}
        if not c.is_("{"):
            raise SourceError(f"{self.path}, line {c.lines[c.at]}: a body was expected")
        end = c.partner[c.at]
        fields: dict[str, str] = {}
        self.scopes.append(fields)
        self.collect_fields(c.at + 1, end, fields)
        c.at += 1
        if kind == "enum":
            while c.at < end and not c.is_(";"):
                c.at = c.past(c.at) if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op" else c.at + 1
            c.take(";")
        while c.at < end:
            before = c.at
            self.member(row if counted else owner, class_id)
            if c.at == before:
                c.at += 1
        self.scopes.pop()
        c.at = end + 1
        if row is not None:
            self.add(**row)  # members stand before their class

    def collect_fields(self, i: int, end: int, fields: dict[str, str]) -> None:
        """Names and types that a class body declares at its own level."""
        c = self.c
        while i < end:
            text, kind = c.texts[i], c.kinds[i]
            if kind == "op" and text in OPENERS:
                i = c.past(i)
                continue
            if kind == "id" and text not in MODIFIERS and (i == 0 or c.texts[i - 1] in (";", "{", "}", ")") or c.texts[i - 1] in MODIFIERS or c.kinds[i - 1] == "id"):
                after = self.type_end(i)
                if after > i and c.kinds[after] == "id" and c.texts[after + 1] in (";", "=", ","):
                    fields[c.texts[after]] = c.text(i, after)
                    i = after
            i += 1

    def callable_(self, start: int, annotations: list[dict], modifiers: list[str], name: str, returns: str, kind: str, owner_id: str | None) -> None:
        c = self.c
        params, scope = [], {}
        for i, j in c.parts(c.at + 1, c.partner[c.at]):
            c_at, c.at = c.at, i
            self.prefix()
            after = self.type_end(c.at)
            type_, given = c.text(c.at, after), c.texts[after]
            extra = "".join(c.texts[after + 1 : j])
            c.at = c_at
            if given == "this":
                continue
            # A variable-length parameter's type is written without its dots.
            params.append({"name": given, "type": type_.removesuffix("...").strip() + extra, "many": type_.endswith("...")})
            scope[given] = params[-1]["type"] + ("[]" if params[-1]["many"] else "")
        c.at = c.past(c.at)
        while not c.done and not c.is_("{", ";"):
            c.at += 1
        class_id = owner_id or "unknown-class"
        sig = f"{name}({', '.join(p['type'] for p in params)})"
        id_ = f"{class_id}#{sig}"
        self.add(id=id_, kind=kind, declaring_class_id=class_id, name=name, signature=sig, return_type=returns, params=[{"name": p["name"], "type": p["type"]} for p in params], many=bool(params) and params[-1]["many"], modifiers=modifiers, line=c.lines[start], annotations=[a["label"] for a in annotations], raw_annotations=annotations, receiver_type="", injection=kind, supertypes=[], imports=dict(self.imports), wildcards=list(self.wildcards))
        for row in self.symbols[-1:]:
            row["owner"] = class_id
        if c.is_("{"):
            end = c.partner[c.at]
            if self.calls:
                self.scopes.append(scope)
                self.body(id_, class_id, c.at + 1, end)
                self.scopes.pop()
            c.at = end + 1
        else:
            c.take(";")

    # --- calls ---

    def body(self, caller: str, class_id: str, start: int, end: int) -> None:
        """Calls of a body in order; a local name holds from its declaration to the end of its block or statement."""
        c, self.blocks = self.c, [(end, {})]
        for i in range(start, end):
            text, kind, before, before_kind = c.texts[i], c.kinds[i], c.texts[i - 1], c.kinds[i - 1]
            while self.blocks[-1][0] < i:
                self.blocks.pop()
            if kind == "op" and text == "{":
                self.blocks.append((c.partner[i], {}))
            elif kind == "id" and text in ("for", "try", "catch") and c.texts[i + 1] == "(":
                self.blocks.append((self.statement_end(c.past(i + 1)), {}))
            if kind == "id" and text not in NOT_NAMES and before not in (".", "new", "::") and not (before_kind == "id" and before not in NOT_NAMES | MODIFIERS):
                after = self.type_end(i)
                if after > i and c.kinds[after] == "id" and c.texts[after] not in NOT_NAMES and c.texts[after + 1] in ("=", ";", ":", ",", ")"):
                    type_ = c.text(i, after)
                    if type_ == "var" and c.texts[after + 2] == "new":
                        type_ = c.text(after + 3, self.type_end(after + 3))
                    self.blocks[-1][1][c.texts[after]] = type_
            if kind == "id" and text not in NOT_NAMES and c.texts[i + 1] == "(" and c.kinds[i + 1] == "op" and self.calls_at(i):
                close = c.partner[i + 1]
                args = c.parts(i + 2, close, angles=False)
                begin = self.chain_start(i)
                kind, type_ = self.receiver(begin, i)
                self.sites.append({"caller_id": caller, "op": "CALL", "name": text, "arity": len(args), "receiver_text": c.text(begin, i - 1) if begin < i else "", "receiver_kind": kind, "receiver_type": type_, "class_id": class_id, "package": self.package, "expr": " ".join(c.text(begin, close + 1).split()), "is_lambda_param": False, "file_path": self.path, "line": c.lines[i], "origin": "JAVA", "imports": dict(self.imports), "wildcards": list(self.wildcards)})

        self.blocks = []

    def statement_end(self, i: int) -> int:
        """The last token of the statement that starts at i; a header in brackets belongs to what it heads."""
        c = self.c
        while i < len(c.texts) - 1 and c.texts[i] not in ("{", ";", "}"):
            i = c.past(i) if c.kinds[i] == "op" and c.texts[i] in OPENERS else i + 1
        return c.partner[i] if c.texts[i] == "{" and c.kinds[i] == "op" else i

    def calls_at(self, i: int) -> bool:
        """Whether `name (` calls: not after new, an annotation's @ or a type, as in local declarations."""
        c = self.c
        j = i
        while c.texts[j - 1] == "." and c.kinds[j - 2] == "id":
            j -= 2
        if c.texts[j - 1] == "new" and (j == i or not any(c.texts[k] == "(" for k in range(j, i))):
            return False
        before, before_kind = c.texts[i - 1], c.kinds[i - 1]
        return before not in ("@", "new") and not (before_kind == "id" and before not in NOT_NAMES) and not (before in (">", "]") and c.texts[c.past(i + 1)] in ("{", "throws", ";") and self.declares(i))

    def declares(self, i: int) -> bool:
        """Whether the brackets after token i hold parameters (each with a type) and not arguments."""
        c = self.c
        parts = c.parts(i + 2, c.partner[i + 1])
        return c.texts[c.past(i + 1)] in ("{", "throws") and all(b - a >= 2 and c.kinds[b - 1] == "id" and c.texts[b - 2] in (">", "]") or c.kinds[b - 2] == "id" for a, b in parts if b - a >= 2)

    def chain_start(self, i: int) -> int:
        """Where the expression begins of which token i names the last call."""
        c = self.c
        while i > 0 and c.texts[i - 1] == "." and c.kinds[i - 1] == "op":
            i -= 2
            while c.texts[i] in (")", "]") and c.kinds[i] == "op":
                i = c.partner[i]
                if c.kinds[i - 1] == "id" and c.texts[i - 1] not in NOT_NAMES or c.texts[i - 1] in (")", "]"):
                    i -= 1
                else:
                    break
            if c.texts[i - 1] == "new":
                i -= 1
        return i

    def receiver(self, begin: int, i: int) -> tuple[str, str]:
        """How the receiver's type is known (THIS, SUPER, TYPE or UNKNOWN), and its name as the source has it."""
        c = self.c
        if begin == i:
            return "THIS", ""
        first, first_kind = c.texts[begin], c.kinds[begin]
        if i - begin == 2:
            if first == "this":
                return "THIS", ""
            if first == "super":
                return "SUPER", ""
            if first_kind == "str":
                return "TYPE", "String"
            if first_kind == "id":
                return "TYPE", self.type_of(first)
        if i - begin == 4 and first == "this" and c.kinds[begin + 2] == "id":
            return "TYPE", self.type_of(c.texts[begin + 2], fields=True)
        if first == "new" or (first == "(" and c.texts[begin + 1] == "new" and c.past(begin) == i - 1):
            at = begin + 1 if first == "new" else begin + 2
            after = self.type_end(at)
            if c.texts[after] == "(" and (c.past(after) == i - 1 or first == "("):
                return "TYPE", c.text(at, after)
        if all(c.kinds[k] == "id" or c.texts[k] == "." for k in range(begin, i - 1)) and c.texts[i - 2][:1].isupper():
            return "TYPE", c.text(begin, i - 1)
        return "UNKNOWN", ""

    def type_of(self, name: str, fields: bool = False) -> str:
        local = [] if fields else [names for _, names in self.blocks]
        for scope in reversed((self.scopes[:-1] if fields else self.scopes) + local):
            if name in scope:
                return scope[name]
        return name


def parse(path: str, source: str, calls: bool = True) -> tuple[list[dict], list[dict]]:
    """Symbols and call sites of one file, in order; bodies are not searched where calls are not wanted."""
    found = JavaFile(path, source, calls).read()
    return found.symbols, found.sites
